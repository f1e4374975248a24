"""Queries of name screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import CYRILLIC, FOLDS, STOP, folded_tokens, jaro_winkler_column, keys_of, normalized, script_of, similarity, tokens, unaccented
from ..operators import screening as sc
from ..session import table
from ..sources.names import CUSTOMER_NAMES_SQL, RECORDS_SQL, VARIED_FAMILY, VARIED_GIVEN, VARIED_SQL, customer_names, list_records, listed_parties, varied_names
from .queries import register

#: Easy and hard negatives of both halves together.
POOL = (8_000, 2_000)


def word_pairs(s, d):
    """Words of the benchmark that begin alike."""
    words = table(s, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("a")).distinct()
    others = words.select(F.col("a").alias("b"))
    pairs = words.join(others, (F.substring("a", 1, 2) == F.substring("b", 1, 2)) & (F.col("a") < F.col("b")))
    return pairs.select("a", "b", F.round(jaro_winkler_column("a", "b"), 9).alias("similarity"))


register(
    "jaro_winkler",
    word_pairs,
    "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS a FROM benchmark) SELECT x.a, y.a AS b, round(jaro_winkler_similarity(x.a, y.a), 9) AS similarity FROM w x JOIN w y ON substr(x.a, 1, 2) = substr(y.a, 1, 2) AND x.a < y.a",
)
register(
    "name_tokens",
    lambda s, d: customer_names(s, d).select("query_id", F.array_join(tokens(normalized("name")), " ").alias("tokens")),
    f"WITH {CUSTOMER_NAMES_SQL} SELECT query_id, array_to_string([t for t in string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' ') if NOT list_contains([{', '.join(repr(x) for x in STOP)}], t)], ' ') AS tokens FROM cnames",
)
register("screening", lambda s, d: sc.screen(customer_names(s, d), listed_parties(s, d)))
register("screening_evaluation", lambda s, d: sc.evaluate(listed_parties(s, d), sc.negatives(customer_names(s, d), listed_parties(s, d), *POOL)))
register("list_description", lambda s, d: sc.describe(listed_parties(s, d)), """SELECT 'parties' AS what, 'individual' AS value, COUNT(*) AS n FROM supplier UNION ALL SELECT 'primary names', 'latin', COUNT(*) FROM supplier UNION ALL SELECT 'aliases', 'latin', COUNT(*) FROM supplier
  UNION ALL SELECT 'with birth year', 'all', COUNT(*) FROM supplier UNION ALL SELECT 'countries', 'all', 1""")


def normal_sql(name: str) -> str:
    """A name's normal form, with the letters that the names of VARIED_SQL hold."""
    used = set("".join((*VARIED_GIVEN, *VARIED_FAMILY)).lower())
    out = f"lower({name})"
    for letter, plain in (CYRILLIC | unaccented()).items():
        if letter in used:
            out = f"replace({out}, '{letter}', '{plain}')"
    return f"trim(regexp_replace(replace(replace(regexp_replace({out}, '\\p{{M}}+', '', 'g'), '&', ' and '), '''', ''), '[^a-z0-9]+', ' ', 'g'))"


def fold_sql(token: str) -> str:
    for a, b in FOLDS:
        token = f"replace({token}, '{a}', '{b}')"
    token = f"replace(replace(replace({token}, 'ch', '#'), 'c', 'k'), '#', 'ch')"
    for letter in "abcdefghijklmnopqrstuvwxyz0123456789":
        token = f"regexp_replace({token}, '{letter}{letter}+', '{letter}', 'g')"
    return token


#: Of each table of names: its tokens by place, folded, and the keys of each folded name.
TOKENS_SQL = ", ".join(
    f"""{t}_normal AS (SELECT query_id, name, {normal_sql("name")} AS normal FROM {t}), {t}_words AS (
  SELECT query_id, name, w.i AS i, w.t AS t FROM (SELECT query_id, name, unnest([{{'i': i, 't': string_split(normal, ' ')[i]}} for i in range(1, len(string_split(normal, ' ')) + 1)]) AS w FROM {t}_normal)
  WHERE w.t <> '' AND w.t NOT IN ({", ".join(f"'{x}'" for x in STOP)})
), {t}_folded AS (SELECT query_id, i, {fold_sql("t")} AS t FROM {t}_words),
{t}_names AS (SELECT query_id, string_agg(t, ' ' ORDER BY i) AS folded FROM {t}_folded GROUP BY 1),
{t}_keys AS (
  SELECT DISTINCT n.folded, k.k FROM {t}_names n JOIN (
    SELECT query_id, unnest(CASE WHEN length(t) < 3 THEN ['w:' || t] WHEN length(regexp_replace(t, '[aeiou]', '', 'g')) < 3 THEN ['p:' || left(t, 3), 's:' || right(t, 3)]
      ELSE ['p:' || left(t, 3), 's:' || right(t, 3), 'c:' || left(regexp_replace(t, '[aeiou]', '', 'g'), 3)] END) AS k FROM {t}_folded) k ON k.query_id = n.query_id)"""
    for t in ("vnames", "vlisted")
)
VARIED = f"WITH {VARIED_SQL}, {TOKENS_SQL}"
folded_of = lambda c: F.array_join(folded_tokens(F.col(c)), " ")


def asked(s, d):
    return varied_names(s, d).select(folded_tokens(F.col("name")).alias("q_folded")).where(F.size("q_folded") > 0)


def listed(s, d):
    return varied_names(s, d, "supplier", "s_suppkey").select(folded_tokens(F.col("name")).alias("folded")).where(F.size("folded") > 0)


def word_scores(s, d):
    """The similarity of names of one word: each folded word of a customer's name with each of a supplier's that shares a key."""
    words = lambda df, c: df.select(F.explode(c).alias("w")).distinct().select(F.array("w").alias(c))
    pairs = sc.candidates(words(asked(s, d), "q_folded"), words(listed(s, d), "folded"))
    return pairs.select(F.element_at("q_folded", 1).alias("query"), F.element_at("folded", 1).alias("word"), F.round(similarity("q_folded", "folded"), 9).alias("score"))


WORDS_SQL = ", ".join(f"{t}_one AS (SELECT DISTINCT t FROM {t}_folded), {t}_onekeys AS (SELECT t, unnest(CASE WHEN length(t) < 3 THEN ['w:' || t] WHEN length(regexp_replace(t, '[aeiou]', '', 'g')) < 3 THEN ['p:' || left(t, 3), 's:' || right(t, 3)] ELSE ['p:' || left(t, 3), 's:' || right(t, 3), 'c:' || left(regexp_replace(t, '[aeiou]', '', 'g'), 3)] END) AS k FROM {t}_one)" for t in ("vnames", "vlisted"))
register("normal_names", lambda s, d: varied_names(s, d).select("query_id", normalized("name").alias("normal")), f"{VARIED} SELECT query_id, normal FROM vnames_normal")
register("folded_names", lambda s, d: varied_names(s, d).select("query_id", folded_of("name").alias("folded")), f"{VARIED} SELECT v.query_id, COALESCE(n.folded, '') AS folded FROM vnames v LEFT JOIN vnames_names n ON n.query_id = v.query_id")
register("blocking_keys", lambda s, d: asked(s, d).distinct().select(F.array_join("q_folded", " ").alias("folded"), F.explode(keys_of(F.col("q_folded"))).alias("k")), f"{VARIED} SELECT folded, k FROM vnames_keys")
register(
    "name_scripts",
    lambda s, d: varied_names(s, d).groupBy(script_of(F.col("name")).alias("script")).agg(F.count(F.lit(1)).alias("names")),
    f"""WITH {VARIED_SQL} SELECT CASE WHEN NOT regexp_matches(name, '\\p{{L}}') OR regexp_matches(regexp_replace(name, '[\\p{{Latin}}\\p{{Cyrillic}}]', '', 'g'), '\\p{{L}}') THEN 'other' WHEN regexp_matches(name, '\\p{{Cyrillic}}') THEN 'cyrillic' ELSE 'latin' END AS script, COUNT(*) AS names FROM vnames GROUP BY 1""",
)
register(
    "name_candidates",
    lambda s, d: sc.candidates(asked(s, d), listed(s, d)).select(F.array_join("q_folded", " ").alias("query"), F.array_join("folded", " ").alias("name")),
    f"{VARIED} SELECT DISTINCT q.folded AS query, l.folded AS name FROM vnames_keys q JOIN vlisted_keys l ON l.k = q.k",
)
register(
    "word_similarity",
    word_scores,
    f"""{VARIED}, {WORDS_SQL} SELECT query, word, round(0.85 * CASE WHEN least(length(query), length(word)) = 1 THEN CASE WHEN left(query, 1) = left(word, 1) THEN 0.9 ELSE 0.0 END ELSE jaro_winkler_similarity(query, word) END + 0.15, 9) AS score
    FROM (SELECT DISTINCT q.t AS query, l.t AS word FROM vnames_onekeys q JOIN vlisted_onekeys l ON l.k = q.k)""",
)
register(
    "listed_names",
    lambda s, d: sc.parties(list_records(s, d)).select("party", "kind", "birth_year", F.explode("names").alias("name"), F.element_at("names", 1).alias("primary_name")),
    f"""WITH {RECORDS_SQL}, named AS (
      SELECT *, last IS NOT NULL OR given IS NOT NULL AS person, CASE WHEN last IS NOT NULL OR given IS NOT NULL THEN trim(COALESCE(given || ' ', '') || COALESCE(last, '')) ELSE COALESCE(body, '') END AS primary_name FROM records
    ), parts AS (
      SELECT item, unnest(regexp_split_to_array(COALESCE(aliases, ''), CASE WHEN person THEN ';|\\n|\\s/\\s|\\baka\\b|\\ba\\.k\\.a\\.|,' ELSE ';|\\n|\\s/\\s|\\baka\\b|\\ba\\.k\\.a\\.' END)) AS part FROM named
    ), every AS (
      SELECT item, primary_name AS name FROM named UNION SELECT item, regexp_replace(part, '^[ ,.]+|[ ,.]+$', '', 'g') FROM parts
    )
    SELECT '1|' || n.item || '|' || country AS party, CASE WHEN person THEN 'individual' WHEN imo IS NOT NULL THEN 'ship' ELSE 'entity' END AS kind,
      CASE WHEN person THEN CAST(NULLIF(regexp_extract(born, '\\b(1[89]\\d\\d|20\\d\\d)\\b', 1), '') AS INTEGER) END AS birth_year, name, primary_name
    FROM named n JOIN every e ON e.item = n.item WHERE primary_name <> '' AND name <> ''""",
)
