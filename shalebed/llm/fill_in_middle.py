"""Fill-in-the-middle rearrangement with bit masks of whole texts.

A text's bytes are translated to class digits and read as one big integer, a bit for
each byte. Shifts and boolean operations on it mark where tokens end, bit_count()
counts them, and the byte after the k-th is found by halving the integer: the count
of the lower half tells in which half the k-th bit is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_words import blocks
from .common import WHITE, extended, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_WORD = bytes(0x30 if chr(b) in WHITE else 0x31 for b in range(256))
#: Bytes that begin a character of UTF-8.
_LEAD = bytes(0x30 if 0x80 <= b < 0xC0 else 0x31 for b in range(256))


def _mask(data: bytes, classes: bytes) -> int:
    """Bit i tells the class of byte i."""
    return int(data.translate(classes)[::-1] or b"0", 2)


def token_ends(data: bytes) -> int:
    """The mask of the last bytes of all tokens: white space and the word behind it, or
    the white space that ends a text.
    """
    word = _mask(data, _WORD)
    ends = word & ~(word >> 1)
    return ends | 1 << (len(data) - 1) if data and not word >> (len(data) - 1) else ends


def place_of(mask: int, k: int, width: int) -> int:
    """Where the k-th bit (from 1) of a mask of width bits is."""
    base = 0
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if k <= below:
            mask, width = low, half
        else:
            mask, width, k, base = mask >> half, width - half, k - below, base + half
    return base


def rearranged(doc_id: int | None, data: bytes, seed: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, characters of prefix and middle, and the output of one text."""
    ends = token_ends(data)
    n = ends.bit_count()
    hashed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hashed[i : i + 8], 16) for i in range(0, 32, 8)]
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not data or h[2] % 100 >= rate or any(m in data for m in marks):
        return n, "plain", None, None, data
    cuts = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    to, till = (place_of(ends, k, len(data)) + 1 if k else 0 for k in cuts)
    lead = _mask(data, _LEAD)
    chars = [(lead & ((1 << p) - 1)).bit_count() for p in (to, till)]
    prefix, middle, suffix = data[:to], data[to:till], data[till:]
    p, s, m = marks
    if h[3] % 100 < spm_rate:
        return n, "spm", chars[0], chars[1] - chars[0], b"".join([s, suffix, p, prefix, m, middle])
    return n, "psm", chars[0], chars[1] - chars[0], b"".join([p, prefix, s, suffix, m, middle])


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """docs with n, form (plain, psm or spm), prefix_chars, middle_chars and output.

    rate of 100 texts are rearranged, spm_rate of 100 of these suffix first; the draws and
    both cuts are from sha256 of seed and doc_id, so they don't depend on partitions. A
    null doc_id counts as no digits. A null or empty text, and one that holds a mark, is
    plain. Columns of the new names are replaced, all others pass through; repeated rows
    come out alike; an empty table gives an empty one. Masks take an eighth of the longest
    text's size, and time in proportion to it. One pass, no shuffle.
    """
    docs = docs.drop("n", "form", "prefix_chars", "middle_chars", "output")

    def run(batches):
        for part, texts in blocks(batches, "text"):
            ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
            _, offsets, data = texts.buffers()
            ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
            view = memoryview(data or b"")
            rows = [rearranged(i, bytes(view[a:b]), seed, rate, spm_rate) for i, a, b in zip(ids, ends, ends[1:], strict=False)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            columns[4] = pa.StringArray.from_buffers(len(rows), columns[4].buffers()[1], columns[4].buffers()[2])
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.mapInArrow(run, extended(docs, "n long, form string, prefix_chars long, middle_chars long, output string"))


def restored(output: Column, form: Column) -> Column:
    """The text that was rearranged. Marks are found from left to right: a text that holds
    one stays plain, and none can begin before a mark and end in it.
    """
    first, second = F.when(form == "psm", PREFIX).otherwise(SUFFIX), F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    rest = F.substr(output, F.length(first) + 1)
    a, b = F.position(second, rest), F.position(F.lit(MIDDLE), rest)
    head, tail = F.substr(rest, F.lit(1), a - 1), F.substr(rest, a + len(MIDDLE), b - a - len(MIDDLE))
    middle = F.substr(rest, b + len(MIDDLE))
    return F.when(form == "psm", F.concat(head, middle, tail)).when(form == "spm", F.concat(tail, middle, head)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_in_middle(docs).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


_DRAW = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
OP12_SQL = f"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
        regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS tokens
    FROM documents
), drawn AS (
    SELECT doc_id, text, tokens, len(tokens) AS n, {_DRAW.format(1)} % (len(tokens) + 1) AS c1, {_DRAW.format(9)} % (len(tokens) + 1) AS c2,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_DRAW.format(17)} % 100 >= 50 THEN 'plain'
            WHEN {_DRAW.format(25)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM texts
), cut AS (
    SELECT doc_id, text, n, form, array_to_string(tokens[1:least(c1, c2)], '') AS prefix,
        array_to_string(tokens[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle, array_to_string(tokens[greatest(c1, c2) + 1:], '') AS suffix
    FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM cut
"""
