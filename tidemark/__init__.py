"""Tidemark: payment-activity analytics and corpus preparation as Spark DataFrame jobs."""
