"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Words become numbers, and rolling 64-bit hashes of all n-grams of several
lengths run over whole slices of a batch at once in numpy; sorting finds the
n-grams that occur twice or more in their text, and a running sum over their
windows gives the words, and so the characters, that they cover.

Defined results: a null text has no words; texts with fewer words than an
n-gram have none of that length; empty and very short texts fail the base rule
on words; texts of any length are read whole (a slice holds at least one text);
repeated rows repeat their result; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import documents, spread, text_slices

#: Most share of word characters inside n-grams of that length that occur twice or more.
MOST_REPEATED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Most share of word characters in all places of the one most frequent n-gram, if that has MIN_TOP places.
MOST_TOP = {2: 0.20, 3: 0.18, 4: 0.16}
MIN_TOP = 4
#: Most share of word characters in lines that equal an earlier line.
MOST_LINES = 0.20
#: The base rules: fewest words, and most words in repeated windows of BASE_WINDOW words, in hundredths.
MIN_WORDS, BASE_WINDOW, MOST_REPEAT_WORDS = 10, 5, 20

_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"

_COLUMNS = (
    ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]
    + [f"repeat_chars_{n}" for n in MOST_REPEATED]
    + [f"top_chars_{n}" for n in MOST_TOP]
)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """Every measure of ``_COLUMNS``, an array with one entry a text."""
    rows = len(texts)
    out = {c: np.zeros(rows, np.int64) for c in _COLUMNS}
    numbers: dict[bytes, int] = {}
    ids: list[int] = []
    for i, text in enumerate(texts):
        raw = text.encode("utf-8")
        words = raw.split()  # of bytes: at exactly U+0009 to U+000D and U+0020
        out["n_words"][i] = len(words)
        out["word_chars"][i] = len(text) - (len(raw) - len(raw.translate(None, _SPACES)))
        out["n_symbols"][i] = len(raw) - len(raw.translate(None, _SYMBOLS))
        seen: set[bytes] = set()
        for line in raw.split(b"\n"):
            if line in seen:
                out["n_dup_lines"][i] += 1
                out["dup_line_chars"][i] += len(line.translate(None, _SPACES).decode("utf-8"))
            elif line.translate(None, _SPACES):
                seen.add(line)
        ids += [numbers.setdefault(w, len(numbers)) for w in words]
    if not ids:
        return out
    number = np.array(ids, np.int64)
    chars = np.array([len(w.decode("utf-8")) for w in numbers], np.int64)[number]
    before = np.append(0, np.cumsum(chars))
    ends = np.cumsum(out["n_words"])
    row = np.repeat(np.arange(rows), out["n_words"])
    room = ends[row] - np.arange(len(row))  # words from here to the text's end
    symbol = _mixed(number.astype(np.uint64))
    text_key = _mixed(row.astype(np.uint64) + np.uint64(1 << 40))
    rolling = np.zeros(len(row), np.uint64)
    for n in range(1, 1 + max(*MOST_REPEATED, *MOST_TOP, BASE_WINDOW)):
        shifted = np.append(symbol[n - 1 :], np.zeros(min(n - 1, len(symbol)), np.uint64))[: len(row)]
        rolling = rolling * np.uint64(0xD6E8FEB86659FD93) + shifted
        if n not in MOST_REPEATED and n not in MOST_TOP and n != BASE_WINDOW:
            continue
        start = np.flatnonzero(room >= n)
        if not len(start):
            break
        key = _mixed(rolling[start]) ^ text_key[start]
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.append(True, ranked[1:] != ranked[:-1])
        run = np.cumsum(new) - 1
        count = np.bincount(run)
        if n in MOST_REPEATED or n == BASE_WINDOW:
            windows = start[order[count[run] > 1]]
            change = np.zeros(len(row) + 1, np.int64)
            np.add.at(change, windows, 1)
            np.add.at(change, windows + n, -1)
            inside = np.cumsum(change[:-1]) > 0
            if n == BASE_WINDOW:
                out["n_repeat_words"] = np.bincount(row[inside], minlength=rows)
            if n in MOST_REPEATED:
                out[f"repeat_chars_{n}"] = np.bincount(row[inside], chars[inside], rows).astype(np.int64)
        if n in MOST_TOP:
            head = start[order[new]]
            many = count >= MIN_TOP
            covered = count[many] * (before[head[many] + n] - before[head[many]])
            np.maximum.at(out[f"top_chars_{n}"], row[head[many]], covered)
    return out


def repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and every measure, one row per input row."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start, stop in text_slices(batch.column(1), 2 << 20):
                part = batch.slice(start, stop - start)
                found = measure([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[c]) for c in _COLUMNS)], ["doc_id", *_COLUMNS])

    rows = spread(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{c} bigint" for c in _COLUMNS))


def judged(measures: DataFrame) -> DataFrame:
    """Add base_failed and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEAT_WORDS)
    over = F.col("dup_line_chars") > F.col("word_chars") * MOST_LINES
    for n, most in MOST_REPEATED.items():
        over = over | (F.col(f"repeat_chars_{n}") > F.col("word_chars") * most)
    for n, most in MOST_TOP.items():
        over = over | (F.col(f"top_chars_{n}") > F.col("word_chars") * most)
    return measures.withColumn("base_failed", failed).withColumn("kept", ~failed & ~over)


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(repetition(documents(spark, sf_dir)))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(*first, *[c for c in _COLUMNS if c not in first])


def _sql() -> str:
    """The same measures and verdicts as SQL; a table's doc_id must be unique and not null."""
    parts, joins, over = [], [], [f"dup_line_chars > word_chars * {MOST_LINES}"]
    for n in sorted({*MOST_REPEATED, *MOST_TOP, BASE_WINDOW}):
        parts.append(f"""g{n} AS (
  SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS gram FROM w),
k{n} AS (SELECT doc_id, gram, list(i) AS places, count(*) AS c FROM g{n} WHERE len(gram) = {n} GROUP BY doc_id, gram HAVING count(*) > 1)""")
        if n in MOST_REPEATED or n == BASE_WINDOW:
            parts.append(f"""d{n} AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS chars FROM w
  JOIN (SELECT DISTINCT doc_id, p + x AS i FROM (SELECT doc_id, unnest(places) AS p FROM k{n}), unnest(range(0, {n})) AS u(x)) USING (doc_id, i) GROUP BY doc_id)""")
            joins.append(f"LEFT JOIN d{n} ON d{n}.doc_id = base.doc_id")
        if n in MOST_TOP:
            parts.append(f"""t{n} AS (
  SELECT doc_id, max(c * list_sum(list_transform(gram, lambda x: length(x)))) AS chars FROM k{n} WHERE c >= {MIN_TOP} GROUP BY doc_id)""")
            joins.append(f"LEFT JOIN t{n} ON t{n}.doc_id = base.doc_id")
    columns = [f"cast(coalesce(d{BASE_WINDOW}.n_words, 0) AS bigint) AS n_repeat_words"]
    for name, most, table in [(f"repeat_chars_{n}", m, f"d{n}") for n, m in MOST_REPEATED.items()] + [(f"top_chars_{n}", m, f"t{n}") for n, m in MOST_TOP.items()]:
        columns.append(f"cast(coalesce({table}.chars, 0) AS bigint) AS {name}")
        over.append(f"{name} > word_chars * {most}")
    failed = f"(n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MOST_REPEAT_WORDS})"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM docs)),
line AS (
  SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL),
lines AS (
  SELECT doc_id, sum(c - 1) AS n, sum((c - 1) * length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS chars FROM line GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n, sum(length(word)) AS chars FROM w GROUP BY doc_id),
base AS (
  SELECT docs.doc_id, cast(coalesce(counts.n, 0) AS bigint) AS n_words, cast(coalesce(counts.chars, 0) AS bigint) AS word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
    cast(coalesce(lines.n, 0) AS bigint) AS n_dup_lines, cast(coalesce(lines.chars, 0) AS bigint) AS dup_line_chars
  FROM docs LEFT JOIN counts ON counts.doc_id = docs.doc_id LEFT JOIN lines ON lines.doc_id = docs.doc_id),
{", ".join(parts)},
found AS (SELECT base.*, {", ".join(columns)} FROM base {" ".join(joins)})
SELECT *, {failed} AS base_failed, NOT {failed} AND NOT ({" OR ".join(over)}) AS kept FROM found"""


OP5_SQL = _sql()
