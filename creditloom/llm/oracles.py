"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from creditloom.llm.mixing import WEIGHTS
from creditloom.llm.quality import LEVEL, RISK, RULES

#: CRC-32 of a text's bytes, one table step a byte.
_CRC = """
bits AS (SELECT list(c ORDER BY b) AS crc_table FROM (
  SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, i:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(256) AS r(b)))"""

OP6 = f"""
WITH {_CRC.strip()},
raw AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
thin AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS stratum, strlen(t) + 8 AS size,
  md5('shard-0:' || coalesce(doc_id::VARCHAR, 'null')) AS k,
  xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(t)), lambda i:
    ('0x' || substr(hex(encode(t)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM raw, bits),
placed AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY k, doc_id, text_crc32, size) - 1 + 0.5::DOUBLE)
  / count(*) OVER (PARTITION BY stratum) AS place FROM thin),
lined AS (SELECT *, row_number() OVER (ORDER BY place, stratum) - 1 AS position, count(*) OVER () AS n FROM placed)
SELECT doc_id, source, size, text_crc32, 'rows' AS law, (position * 24 // n)::INTEGER AS shard,
  position - ((position * 24 // n) * n + 23) // 24 AS slot, NULL::INTEGER AS grown_shard
FROM lined"""

_WEIGHT = " ".join(f"WHEN {i} THEN {float(w)}::DOUBLE" for i, w in enumerate(WEIGHTS))

OP7 = f"""
WITH sized AS (SELECT doc_id, source, coalesce('s' || source, 'z') AS stratum,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
  md5('mix-0:' || coalesce(doc_id::VARCHAR, 'null')) AS k, row_number() OVER () AS r FROM documents),
sources AS (SELECT stratum, sum(size)::BIGINT AS source_size,
  CASE (row_number() OVER (ORDER BY stratum) - 1) % {len(WEIGHTS)} {_WEIGHT} END AS weight FROM sized GROUP BY stratum),
filled AS (SELECT *, source_size * 2::DOUBLE AS lim, source_size * 2::DOUBLE / weight AS fill,
  sum(source_size::DOUBLE) OVER () * 1.5::DOUBLE AS budget FROM sources),
stepped AS (SELECT *, coalesce(sum(lim) OVER w, 0) + fill * (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))
  <= budget AS is_full FROM filled
  WINDOW w AS (ORDER BY fill, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levelled AS (SELECT *, (budget - sum(CASE WHEN is_full THEN lim ELSE 0 END) OVER ())
  / nullif(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (), 0) AS water FROM stepped),
targets AS (SELECT stratum, source_size, weight, budget,
  CASE WHEN is_full THEN lim ELSE weight * water END AS target FROM levelled),
queued AS (SELECT r, stratum, pass, k, doc_id, size,
  sum(size) OVER (PARTITION BY stratum ORDER BY pass, k, doc_id, size, r ROWS UNBOUNDED PRECEDING)::DOUBLE AS cum
  FROM sized, (VALUES (0), (1)) AS p(pass) WHERE size > 0),
lined AS (SELECT q.r, q.size, t.budget, sum(q.size) OVER (ORDER BY q.cum / t.weight, q.stratum, q.pass, q.k, q.doc_id, q.size
  ROWS UNBOUNDED PRECEDING) AS served FROM queued AS q JOIN targets AS t USING (stratum)),
taken AS (SELECT r, sum(size) AS taken FROM lined WHERE served <= budget GROUP BY r)
SELECT doc_id, source, size, source_size, target, coalesce(taken.taken, 0)::BIGINT AS taken
FROM sized JOIN targets USING (stratum) LEFT JOIN taken USING (r)"""


def _ratio(rule: str) -> str:
    return {
        "symbols_per_word": "n_symbols",
        "dup_lines_per_word": "n_dup_lines",
        "repeats_per_word": "n_repeat_words",
        "chars_per_word": "word_chars",
    }[rule] + " / n_words::DOUBLE"


_RUNGS = ", ".join(
    f"('{rule}', {i}, {sign}, {float(c)}::DOUBLE)"
    for rule, (sign, ladder) in RULES.items()
    for i, c in enumerate(ladder)
)
_WORST = "CASE rule " + " ".join(f"WHEN '{rule}' THEN {rule}" for rule in RULES) + " END"
#: The share of the risk that each rule has.
_EACH = f"{RISK / len(RULES)}::DOUBLE"

OP2 = f"""
WITH raw AS (SELECT doc_id, lang, coalesce('l' || lang, 'n') AS stratum, coalesce(text, '') AS t,
  row_number() OVER () AS r FROM documents),
parts AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM raw),
windows AS (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM parts)),
twice AS (SELECT r, g FROM windows GROUP BY r, g HAVING count(*) > 1),
marks AS (SELECT r, count(DISTINCT i + o) AS n FROM windows JOIN twice USING (r, g), (VALUES (0), (1), (2)) AS v(o)
  GROUP BY r),
counted AS (SELECT r, doc_id, lang, stratum, len(w)::BIGINT AS n_words,
  length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(marks.n, 0)::BIGINT AS n_repeat_words
  FROM parts LEFT JOIN marks USING (r)),
measured AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM counted),
rungs AS (SELECT * FROM (VALUES {_RUNGS}) AS v(rule, i, side, cutoff)),
good AS (SELECT stratum, doc_id, {", ".join(f"max({sign} * ({_ratio(rule)})) AS {rule}" for rule, (sign, _) in RULES.items())}
  FROM measured WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY stratum, doc_id),
counts AS (SELECT stratum, rule, i, any_value(cutoff) AS cutoff, count(*) AS n,
  count(*) FILTER (WHERE {_WORST} > side * cutoff) AS k FROM good, rungs GROUP BY stratum, rule, i),
tails AS (SELECT *, (SELECT count(DISTINCT stratum) FROM good) AS strata,
  CASE WHEN k > n * {_EACH} THEN 1 ELSE list_sum(list_transform(range(k + 1), lambda j:
    exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_EACH}) + (n - j) * ln(1 - {_EACH})))) END AS p
  FROM counts),
climbed AS (SELECT *, bool_and(p <= {LEVEL}::DOUBLE / (strata * {len(RULES)}))
  OVER (PARTITION BY stratum, rule ORDER BY i) AS ok FROM tails),
cutoffs AS (SELECT stratum, {", ".join(
    f"arg_max(cutoff, i) FILTER (WHERE ok AND rule = '{rule}') AS {rule}_cutoff" for rule in RULES
)} FROM climbed GROUP BY stratum)
SELECT doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  {", ".join(f"{rule}_cutoff" for rule in RULES)},
  NOT (base_failed {" ".join(
    f"OR coalesce({sign} * ({_ratio(rule)}) > {sign} * {rule}_cutoff, false)" for rule, (sign, _) in RULES.items()
)}) AS kept
FROM measured LEFT JOIN cutoffs USING (stratum)"""

ORACLE = {"op2_quality_rules": OP2, "op6_stratified_shards": OP6, "op7_fair_mix": OP7}
