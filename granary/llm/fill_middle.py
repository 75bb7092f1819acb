"""Fill-in-the-middle transformation by displacement scatter.

A text is cut into tokens (white space with the word after it); two seeded cuts leave a prefix, a middle and
a suffix, which are rearranged behind sentinels. Whole batches are transformed at once: a scan of the UTF-8
bytes finds the token ends, the cuts put the change of displacement into a difference array, its cumulative
sum is the output shift of every byte, and one scatter moves all bytes. ``restore_middle`` reads nothing but
output and form: it finds the sentinels, sums the inverse displacements and gathers the bytes back.

Seeds are groups of a SHA-256 of the seed and the doc_id, so a recomputed task makes the same cuts. Rows need
no shuffle, and the work of a task is one chunk of about a megabyte, or one text if that is longer.

Defined cases: null text counts as empty; an empty text, one that holds a sentinel and one whose draw is
against it stay plain; a text of white space only is one token; cuts at the same place leave empty parts; a
null doc_id is seeded as an empty string; rows with equal doc_id and text give equal output; an empty table
gives an empty one; all columns of the input stay, those called like a result (n, form, prefix_chars,
middle_chars, fim_text) are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import fresh

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, those rearranged; of 100 of these, those with the suffix first.
FIM_RATE, SPM_RATE = 50, 80
PLAIN, PSM, SPM = 0, 1, 2
FORMS = pa.array(["plain", "psm", "spm"])
RESULT = "n long, form string, prefix_chars long, middle_chars long, fim_text string"
_SENTINEL = 3  # bytes of each


def _token_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte ends of tokens, first token of each document): a token ends with a word, or with the document if white space is left."""
    word = bt.NONSPACE[data]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    ends[last] = True
    at = np.flatnonzero(ends) + 1
    return at, np.searchsorted(at, offsets, "right")


def _holds_sentinel(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents contain one of the sentinels."""
    out = np.zeros(len(offsets) - 1, bool)
    out[_sentinels(data, offsets)[1]] = True
    return out


def _sentinels(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, documents) of sentinels, in order; none reaches from one document into the next."""
    at = np.zeros(0, np.int64)
    if len(data) >= _SENTINEL:
        at = np.flatnonzero((data[:-2] == ord("<")) & np.isin(data[1:-1], np.frombuffer(b"PSM", np.uint8)) & (data[2:] == ord(">")))
    owner = np.searchsorted(offsets, at, "right") - 1
    inside = at + _SENTINEL <= offsets[owner + 1]
    return at[inside], owner[inside]


def _displaced(starts: list[np.ndarray], shifts: list[np.ndarray], n: int) -> np.ndarray:
    """For each of n bytes its place after the shift of the segment it is in. Segments are given in order of their
    starts; empty ones share a start with their successor, whose difference is added on top."""
    step = np.zeros(n + 1, np.int64)
    start, shift = np.stack(starts, 1).ravel(), np.stack(shifts, 1).ravel()
    np.add.at(step, start, np.diff(shift, prepend=0))
    return np.arange(n) + np.cumsum(step[:-1])


def rearrange(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray) -> dict[str, np.ndarray]:
    """Outputs of a run of documents, given their four draws: bytes, offsets, and n, form and cuts of each."""
    ends, first = _token_ends(data, offsets)
    n = np.diff(first)
    low, high = np.sort(draws[:2] % (n + 1), axis=0)
    begin, size = offsets[:-1], np.diff(offsets)
    bound = np.append(ends, 0)  # the last entry stands for no token
    a, b = (np.where(k > 0, bound[np.where(k > 0, first[:-1] + k - 1, len(ends))], begin) for k in (low, high))
    form = np.where((size == 0) | _holds_sentinel(data, offsets) | (draws[2] % 100 >= FIM_RATE), PLAIN, np.where(draws[3] % 100 < SPM_RATE, SPM, PSM))
    out = np.concatenate([[0], np.cumsum(size + np.where(form == PLAIN, 0, 3 * _SENTINEL))])
    head, middle, tail = a - begin, b - a, offsets[1:] - b
    at = out[:-1] - begin  # shift of a plain text
    p = at + np.choose(form, [0, _SENTINEL, tail + 2 * _SENTINEL])
    s = at + np.choose(form, [0, 2 * _SENTINEL - middle, _SENTINEL - head - middle])
    m = at + np.choose(form, [0, tail + 3 * _SENTINEL, tail + 3 * _SENTINEL])
    made = np.empty(out[-1], np.uint8)
    made[_displaced([begin, a, b], [p, m, s], len(data))] = data
    cut = form != PLAIN
    for mark, place in ((PREFIX, begin + p), (SUFFIX, b + s), (MIDDLE, a + m)):
        made[(place[cut] - _SENTINEL)[:, None] + np.arange(_SENTINEL)] = np.frombuffer(mark.encode(), np.uint8)
    points = bt.code_points(data)
    return {"data": made, "offsets": out, "n": n, "form": form, "prefix": points[a] - points[begin], "middle": points[b] - points[a]}


def rebuild(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts behind outputs. A rearranged output holds each sentinel once, in the order of its form."""
    cut = form != PLAIN
    place, owner = _sentinels(data, offsets)
    marks = place[cut[owner]].reshape(-1, 3)  # three for each rearranged output
    begin, end = offsets[:-1], offsets[1:]
    bounds = np.stack([begin, end, end], 1)  # starts of the second part, of the third, and the end
    bounds[cut] = np.stack([marks[:, 1], marks[:, 2], end[cut]], 1)
    size = np.diff(offsets) - np.where(cut, 3 * _SENTINEL, 0)
    out = np.concatenate([[0], np.cumsum(size)])
    # Lengths of the parts in the order they stand in, and where each begins.
    lead = np.where(cut, _SENTINEL, 0)
    one, two, three = bounds[:, 0] - begin - lead, bounds[:, 1] - bounds[:, 0] - lead, bounds[:, 2] - bounds[:, 1] - lead
    one = np.where(cut, one, np.diff(offsets))
    prefix, suffix = (np.choose(form, [one, one, two]), np.choose(form, [0, two, one]))
    prefix_at = np.choose(form, [begin, begin + lead, bounds[:, 0] + lead])
    suffix_at = np.choose(form, [end, bounds[:, 0] + lead, begin + lead])
    middle_at = np.where(cut, bounds[:, 1] + lead, end)
    three = np.where(cut, three, 0)
    starts = [out[:-1], out[:-1] + prefix, out[:-1] + prefix + three]
    shifts = [prefix_at - starts[0], middle_at - starts[1], suffix_at - starts[2]]
    return data[_displaced(starts, shifts, int(out[-1]))], out


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)]).cast(pa.string())


def _transform(text: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
    draws, parts = np.stack([h.to_numpy(zero_copy_only=False) for h in (h1, h2, h3, h4)]), []
    for lo, hi, data, offsets in bt.chunks(text):
        r = rearrange(data, offsets, draws[:, lo:hi])
        plain = r["form"] == PLAIN
        parts.append(pa.StructArray.from_arrays(
            [pa.array(r["n"]), FORMS.take(pa.array(r["form"])), pa.array(r["prefix"], mask=plain), pa.array(r["middle"], mask=plain), _strings(r["data"], r["offsets"])],
            ["n", "form", "prefix_chars", "middle_chars", "fim_text"],
        ))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("fim_text", pa.string())]))


def _restore(text: pa.Array, form: pa.Array) -> pa.Array:
    kinds, parts = pc.index_in(form, FORMS).to_numpy(zero_copy_only=False), []
    for lo, hi, data, offsets in bt.chunks(text):
        parts.append(_strings(*rebuild(data, offsets, kinds[lo:hi].astype(np.int64))))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def fill_in_middle(docs: DataFrame, seed: int = 42) -> DataFrame:
    """``docs`` with n (tokens), form (plain, psm, spm), prefix_chars, middle_chars and fim_text."""
    docs = docs.drop("n", "form", "prefix_chars", "middle_chars", "fim_text")
    digest, made = fresh(docs, "fim_digest", "fim_made")
    seeded = docs.withColumn(digest, F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256))
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    out = seeded.withColumn(made, F.arrow_udf(_transform, f"struct<{RESULT.replace(' ', ':').replace(',:', ',')}>")(F.coalesce("text", F.lit("")), *draws))
    return out.select(*docs.columns, f"{made}.*")


def restore_middle(output: Column | str, form: Column | str) -> Column:
    """The text behind an output of ``fill_in_middle``, from the output and its form alone."""
    return F.arrow_udf(_restore, "string")(output, form)
