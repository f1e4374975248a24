import hashlib

import pytest

from tidemark.operators import packets
from tidemark.sources import files

REGISTER = "investigation_id string, entity_id string, priority string, due_hours int, case_state string, typology_hypothesis string, rules_fired string, flagged_transactions long, amount_involved_cad double, evidence_references string, decision_status string"
EDGES = "entity_id string, counterparty_id string, transactions long, amount_cad double, directions string"


def case(k, priority="P1"):
    return (f"INV-{k}", f"E{k}", priority, 24, "OPEN TRIAGE", "T02", "R2", 3, 1234.5, "a | $5", "HUMAN DECISION REQUIRED")


def test_packets_hold_the_largest_counterparties(spark, tmp_path):
    register = spark.createDataFrame([case(1), case(2, "P0")], REGISTER)
    edges = spark.createDataFrame([("E1", f"C{k:02d}", k, float(k // 2), "inbound") for k in range(30)], EDGES)
    out = {r["investigation_id"]: r["packet"].split("\n") for r in packets.case_packets(register, edges).collect()}
    want = sorted(((-(k // 2), f"C{k:02d}", k) for k in range(30)))[:20]
    assert [x for x in out["INV-1"] if x.startswith("| C")][1:] == [f"| {c} | {k} | \\${-a:,.2f} | inbound |" for a, c, k in want]
    assert out["INV-1"][-1] == "Further counterparties: 10" and out["INV-2"][-1] == "Further counterparties: 0"
    assert out["INV-2"][0] == "# INV-2" and "Evidence: a \\| \\$5" in out["INV-2"]
    packets.write_packets(packets.case_packets(register, edges), str(tmp_path / "p"))
    text = "".join(p.read_text() for p in (tmp_path / "p" / "priority=P0").glob("part-*"))
    assert text == "\n".join(out["INV-2"]) + "\n---\n"
    assert packets.case_packets(register.where("false"), edges).count() == 0


def test_very_many_cases_are_written_by_tasks(spark, tmp_path):
    register = spark.range(100_000).selectExpr("concat('INV-', id) AS investigation_id", "concat('E', id) AS entity_id", "concat('P', id % 3) AS priority", "24 AS due_hours", "'S' AS case_state", "'T' AS typology_hypothesis", "'R' AS rules_fired", "id AS flagged_transactions", "1D AS amount_involved_cad", "'e' AS evidence_references", "'d' AS decision_status")
    edges = spark.range(100_000).selectExpr("concat('E', id) AS entity_id", "'C' AS counterparty_id", "1L AS transactions", "1D AS amount_cad", "'inbound' AS directions")
    packets.write_packets(packets.case_packets(register, edges), str(tmp_path / "p"))
    assert spark.read.option("lineSep", "\n---\n").text(str(tmp_path / "p")).count() == 100_000


def test_manifest_is_plain_hashing(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"f{k}.txt").write_bytes(b"line\r\n" * k)
    found = packets.manifest(spark, str(tmp_path), "*.txt")
    rows = {r["name"]: (r["bytes"], r["sha256"]) for r in found.collect()}
    assert rows == {f"f{k}.txt": (6 * k, hashlib.sha256(b"line\r\n" * k).hexdigest()) for k in range(1, 40)}
    by = {}
    for name in sorted(rows):
        by.setdefault(hashlib.sha256(name.encode()).hexdigest()[:2], []).append(f"{name} {rows[name][1]}")
    root = hashlib.sha256("".join(hashlib.sha256("\n".join(by[p]).encode()).hexdigest() for p in sorted(by)).encode()).hexdigest()
    assert tuple(packets.manifest_root(found).first()) == (39, 6 * sum(range(40)), root)
    (tmp_path / "f7.txt").write_bytes(b"changed")
    assert packets.manifest_root(packets.manifest(spark, str(tmp_path), "*.txt")).first()["root"] != root
    assert packets.manifest_root(found.where("false")).first()["files"] == 0


def test_digests_do_not_depend_on_line_ends(spark, tmp_path):
    import gzip

    (tmp_path / "a.txt").write_bytes(b"x\r\ny\r\n")
    (tmp_path / "b.txt.gz").write_bytes(gzip.compress(b"x\ny\n"))
    assert files.canonical_digest(spark, str(tmp_path / "a.txt")) == files.canonical_digest(spark, str(tmp_path / "b.txt.gz")) == hashlib.sha256(b"x\ny\n").hexdigest()
    with pytest.raises(ValueError):
        files.markdown_table(spark.range(300))


def test_a_policy_of_many_lines(spark, tmp_path):
    import json

    policy = {"schema_version": 1, "priority_bands": [1, 2], "typologies": [{"id": "T", "minimum_evidence": ["a", "b"]}]}
    (tmp_path / "p.json").write_text(json.dumps(policy, indent=2))
    assert files.read_policy(spark, str(tmp_path / "p.json")) == policy
