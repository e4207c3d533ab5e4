r"""Fill-in-middle transformation by repeated-capture matching.

One possessive full match of ``(unit)*+`` cuts a text into its lines (``[^\n]*\n|[^\n]+``) and keeps every
repetition: ``ends(1)`` is the list of all cut places, so its length is the number of lines and two of its
entries are the borders of prefix, middle and suffix.

Draws come from the sha256 of ``seed:id``: two cuts among n + 1 places, the share of rows that are changed
(``rate``) and of these the share in the order suffix, prefix, middle (``spm_rate``), both in hundredths.
Rows that are empty or hold a sentinel stay as they are (form ``plain``).  ``restore`` finds the sentinels
again and needs the output and its form only.

Null texts count as empty; null ids draw as an empty id; repeated rows are changed alike; columns named like
an output are replaced, all others pass through; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from graupel.llm.text import chunks

SEED, RATE, SPM_RATE = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINES = regex.compile(r"([^\n]*+\n|[^\n]++)*+")
CHUNK = 4 << 20
ADDED = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]


def draws(seed: int, id) -> tuple[int, int, int, int]:
    """The first four 32-bit groups of the hash of ``seed:id``."""
    key = hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).digest()
    return tuple(int.from_bytes(key[k : k + 4], "big") for k in range(0, 16, 4))


def infill(text: str, drawn: tuple[int, int, int, int], rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """Lines, form, characters of prefix and middle, output of one text."""
    ends = LINES.fullmatch(text).ends(1)
    n, (h1, h2, h3, h4) = len(ends), drawn
    if not n or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def restored(output: str, form: str) -> str:
    """The text from an output: its sentinels are the first of their kind in the form's order."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _batches(batch: pa.RecordBatch, fields: list[str], made: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[batch.column(f) for f in fields], *made], names=[*fields, *names])


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """All columns but ``text``, then n, form, prefix_chars, middle_chars and output."""
    names = [n for n, _ in ADDED]
    base = docs.drop(*[c for c in names if c not in (id, text)])
    kept = [f for f in base.schema.fields if f.name != text]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]

    def run(batches):
        for batch, _, _ in chunks(batches, text, CHUNK):
            rows = [infill(t or "", draws(seed, i), rate, spm_rate) for i, t in zip(batch.column(id).to_pylist(), batch.column(text).to_pylist())]
            made = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            made[-1] = made[-1].cast(pa.string())
            yield _batches(batch, [f.name for f in kept], made, names)

    return base.mapInArrow(run, T.StructType([*kept, *[T.StructField(n, t) for n, t in ADDED]]))


def restore(docs: DataFrame, output: str = "output", form: str = "form", out: str = "restored") -> DataFrame:
    """All columns and the text that an output stands for; a null form counts as plain."""
    base = docs.drop(out)

    def run(batches):
        for batch, _, _ in chunks(batches, output, CHUNK):
            made = [restored(o or "", f or "plain") for o, f in zip(batch.column(output).to_pylist(), batch.column(form).to_pylist())]
            yield _batches(batch, batch.schema.names, [pa.array(made, pa.string())], [out])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(out, T.StringType())]))


def infill_query(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = restore(fill_in_middle(docs))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


INFILL_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM docs),
counted AS (SELECT *, CASE WHEN text = '' THEN 0 ELSE len(parts) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END END AS n FROM lines),
drawn AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN text = '' OR h3 % 100 >= {RATE} OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM counted),
cut AS (SELECT *, least(length(text), coalesce(list_sum(list_transform(parts[1:low], lambda x: length(x) + 1)), 0)) AS a,
    least(length(text), coalesce(list_sum(list_transform(parts[1:high], lambda x: length(x) + 1)), 0)) AS b FROM drawn),
parted AS (SELECT *, substring(text, 1, CAST(a AS BIGINT)) AS pre, substring(text, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT)) AS mid, substring(text, CAST(b AS BIGINT) + 1) AS suf FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parted"""
