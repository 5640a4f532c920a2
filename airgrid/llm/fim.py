"""Fill-in-middle transformation with pyarrow.compute.

Each batch of texts is split into list arrays of code points, the lists are flattened with the indices of their parents, ordinals
inside the parent give each code point its role (prefix, middle or suffix), each role is filtered and rebuilt as lists, and
``binary_join`` makes pieces of them. Cuts and forms are SQL expressions of a hash of the document's id, so reruns agree.

Defined results: null and empty texts, and texts that contain a marker, stay plain; a null doc_id is hashed as an empty id; rows
with one id and equal texts are transformed alike; further columns of ``docs`` are ignored. A text is worked on in segments of
``SEGMENT`` bytes, so that the arrays of single code points stay small however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEGMENT = 1 << 20


def _draw(doc_id: Column, i: int) -> Column:
    """The i-th group of eight hexadecimal digits of the id's hash, as an unsigned integer."""
    digits = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("bigint")


def plan(docs: DataFrame, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id, text, n (code points), form (plain, psm or spm), prefix_chars and middle_chars (null if plain)."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.char_length(text).cast("bigint").alias("n"), *(_draw(F.col("doc_id"), i).alias(f"h{i}") for i in range(4)))
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains("text", F.lit(marker))
    form = (F.when((F.col("n") == 0) | marked | (F.col("h2") % 100 >= plain_from), "plain")
            .when(F.col("h3") % 100 < spm_below, "spm").otherwise("psm"))
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("h0", "h1")]
    docs = docs.select("doc_id", "text", "n", form.alias("form"), F.least(*cuts).alias("low"), F.greatest(*cuts).alias("high"))
    cut = F.col("form") != "plain"
    return docs.select("doc_id", "text", "n", "form", F.when(cut, F.col("low")).alias("prefix_chars"), F.when(cut, F.col("high") - F.col("low")).alias("middle_chars"))


def code_points(texts: pa.Array) -> pa.ListArray:
    """The texts as lists of one-character strings that share the texts' bytes."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2] or pa.py_buffer(b"")
    octets = pa.Array.from_buffers(pa.uint8(), int(offsets[-1] - offsets[0]), [None, data.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))])
    first = pc.not_equal(pc.bit_wise_and(octets, pa.scalar(0xC0, pa.uint8())), pa.scalar(0x80, pa.uint8()))
    starts = np.append(pc.indices_nonzero(first).to_numpy().astype(np.int32), np.int32(len(octets)))
    chars = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), data.slice(int(offsets[0])))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, offsets - offsets[0]).astype(np.int32)), chars)


def cut(texts: pa.Array, low: pa.Array, high: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix of each text; the cuts are numbers of code points."""
    units = code_points(texts)
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(units.offsets.cast(pa.int64()), parent))
    before, upto = pc.less(ordinal, pc.take(low, parent)), pc.less(ordinal, pc.take(high, parent))
    pieces = []
    for role in (before, pc.and_not(upto, before), pc.invert(upto)):
        upto_here = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(role.cast(pa.int32()))])
        pieces.append(pc.binary_join(pa.ListArray.from_arrays(pc.take(upto_here, units.offsets), pc.filter(flat, role)), ""))
    return pieces


def segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts in segments of at most SEGMENT bytes, and the row of each segment."""
    if len(texts) != 1 or pc.binary_length(texts[0]).as_py() <= SEGMENT:
        return texts, np.arange(len(texts))
    data, at, out = memoryview(texts[0].as_buffer()), 0, []
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(bytes(data[at:end]))
        at = end
    return pa.array(out, pa.binary()).cast(pa.string()), np.zeros(len(out), np.int64)


def arranged(texts: pa.Array, form: pa.Array, prefix_chars: pa.Array, middle_chars: pa.Array) -> pa.Array:
    """The output text of each row."""
    parts, row = segments(texts)
    lengths = pc.utf8_length(parts).to_numpy().astype(np.int64)
    before = np.cumsum(lengths) - lengths
    base = before - before[np.searchsorted(row, row)]
    low = pc.fill_null(prefix_chars, 0).to_numpy()
    high = low + pc.fill_null(middle_chars, 0).to_numpy()
    pieces = cut(parts, pa.array(low[row] - base), pa.array(high[row] - base))
    if len(parts) != len(texts):
        pieces = [pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(p)], pa.int32()), p), "") for p in pieces]
    prefix, middle, suffix = pieces
    psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    return pc.if_else(pc.equal(form, "plain"), texts, pc.if_else(pc.equal(form, "spm"), spm, psm))


def rebuilt(output: pa.Array, form: pa.Array) -> pa.Array:
    """The original text of each output."""
    def halves(x: pa.Array, marker: str) -> tuple[pa.Array, pa.Array]:
        both = pc.split_pattern(x, marker, max_splits=1)
        return pc.list_element(both, 0), pc.list_element(both, 1)

    result = output
    for name, marker in (("psm", SUFFIX), ("spm", PREFIX)):
        chosen = pc.equal(form, name)
        first, rest = halves(pc.utf8_slice_codeunits(pc.filter(output, chosen), len(PREFIX)), marker)
        second, middle = halves(rest, MIDDLE)
        prefix, suffix = (first, second) if name == "psm" else (second, first)
        result = pc.replace_with_mask(result, chosen, pc.binary_join_element_wise(prefix, middle, suffix, ""))
    return result


def _appended(df: DataFrame, column: str, work) -> DataFrame:
    """``df`` with a text column that ``work`` makes of slices of its batches."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, work.over, SEGMENT):
            yield pa.RecordBatch.from_arrays([*part.columns, work(part)], names=[*names, column])

    return df.mapInArrow(run, df.select("*", F.lit("").alias(column)).schema)


def _output(part: pa.RecordBatch) -> pa.Array:
    return arranged(*(part.column(c) for c in ("text", "form", "prefix_chars", "middle_chars")))


def _restored(part: pa.RecordBatch) -> pa.Array:
    return rebuilt(part.column("output"), part.column("form"))


_output.over, _restored.over = "text", "output"


def transform(docs: DataFrame, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the output text of every document."""
    return _appended(plan(docs, plain_from, spm_below), "output", _output).drop("text")


def restore(outputs: DataFrame) -> DataFrame:
    """Rows of ``transform`` (columns output and form), with the text that each was made of as ``restored``."""
    return _appended(outputs, "restored", _restored)


def digests(docs: DataFrame) -> DataFrame:
    """What ``transform`` did to each document, with hashes of the output and of the text rebuilt from it."""
    rows = restore(transform(docs))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))
