"""Language by rank-order profiles of character n-grams.

A language's profile is its ``size`` most frequent n-grams (1 to 3 characters of lower-cased words, a blank for a
word's edges) over all its training texts, in order. A document's own most frequent n-grams are compared with each
profile by the out-of-place distance: how far each stands from its place there, ``size`` for one that is absent. The
least distance names the language; the score is 1 less that distance over the greatest possible one.

Counting is vectorised over about ``BLOCK`` characters at a time, cut at document ends for predictions and anywhere
between words for training, so memory does not grow with the partition; the profiles are a few hundred rows for each
language and reach the tasks as a broadcast value.

Edge cases: a null text or one without letters is ``und`` with score 0; ties of n-grams go to the lesser one by code
points, ties of languages to the lesser name; with no training text every document is ``und``; rows that repeat are
predicted alike; a null doc_id stays null and is never held out; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCK = 1 << 19
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _LETTER


def _points(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters than letters as one blank, blanks around."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    x = np.where(_letters()[x], x, 32)
    x = np.concatenate(([32], x, [32]))
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    return x[keep]


def _grams(x: np.ndarray) -> list[np.ndarray]:
    """Codes of the n-grams by n: 21 bits a character, the first one highest, 0 where there is none. The lone blank and
    those with a blank in the middle are left out (as -1)."""
    a, b, c = x, x[1:], x[2:]
    one = np.where(a == 32, -1, a << 42)
    two = np.where((a[:-1] == 32) & (b == 32), -1, (a[:-1] << 42) | (b << 21))
    three = np.where(b[:-1] == 32, -1, (a[:-2] << 42) | (b[:-1] << 21) | c)
    return [one, two, three]


def _name(code: int) -> str:
    return "".join(chr(p) for p in (code >> 42, (code >> 21) & 0x1FFFFF, code & 0x1FFFFF) if p)


def _blocks(texts: list[str | None]) -> Iterator[list[int]]:
    """Indices of texts, so that each list has about BLOCK characters."""
    own, size = [], 0
    for i, t in enumerate(texts):
        own.append(i)
        size += len(t or "")
        if size >= BLOCK:
            yield own
            own, size = [], 0
    if own:
        yield own


def _pieces(text: str) -> Iterator[str]:
    """A long text in pieces that end at a blank, as no n-gram spans one."""
    at = 0
    while len(text) - at > 2 * BLOCK:
        cut = text.find(" ", at + BLOCK)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def counts(docs: DataFrame) -> DataFrame:
    """lang, gram (code), n over all texts of ``docs`` (text, lang)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs) if x == lang and t]
                for some in _blocks(own):
                    for piece in _pieces(" ".join(own[i] for i in some)):
                        code, n = np.unique(np.concatenate(_grams(_points(piece))), return_counts=True)
                        k = int(code[:1].sum() < 0) if len(code) else 0
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(code) - k)), pa.array(code[k:]), pa.array(n[k:])], ["lang", "gram", "n"])

    return docs.select("text", "lang").mapInArrow(task, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, size: int = 300) -> DataFrame:
    """lang, gram, rank (from 0): the n-grams of each language's profile."""
    top = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts(docs).select("lang", "gram", (top - 1).alias("rank")).where(F.col("rank") < size)


def _ranked(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, gram, rank) of the ``size`` most frequent n-grams of each text, in order."""
    parts = [_points(t) for t in texts]
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    x = np.concatenate(parts)
    letters, dense = np.unique(x, return_inverse=True)
    bits = max(1, int(len(letters)).bit_length())
    if 3 * bits + int(len(parts)).bit_length() > 62:
        if len(parts) == 1:
            code, n = np.unique(np.concatenate(_grams(x)), return_counts=True)
            code, n = (code[1:], n[1:]) if len(code) and code[0] < 0 else (code, n)
            order = np.lexsort((code, -n))[:size]
            return np.zeros(len(order), np.int64), code[order], np.arange(len(order))
        k = len(parts) // 2
        a, b = _ranked(texts[:k], size), _ranked(texts[k:], size)
        return np.concatenate((a[0], b[0] + k)), np.concatenate((a[1], b[1])), np.concatenate((a[2], b[2]))
    blank, y = (x == 32), dense.astype(np.int64) + 1
    key = doc << (3 * bits)
    same = doc[1:] == doc[:-1]
    one = (key | (y << 2 * bits))[~blank]
    two = (key[:-1] | (y[:-1] << 2 * bits) | (y[1:] << bits))[same]
    three = (key[:-2] | (y[:-2] << 2 * bits) | (y[1:-1] << bits) | y[2:])[same[1:] & same[:-1] & ~blank[1:-1]]
    code, n = np.unique(np.concatenate((one, two, three)), return_counts=True)
    d = code >> (3 * bits)
    # in order of (document, count downwards, n-gram): codes are sorted already, so a stable sort by the rest will do
    order = np.argsort((d << 32) - n, kind="stable")
    d, code = d[order], code[order]
    first = np.searchsorted(d, np.arange(len(parts)))
    rank = np.arange(len(d)) - first[d]
    kept = rank < size
    d, code, rank = d[kept], code[kept], rank[kept]
    points = np.concatenate(([0], letters))
    low = (1 << bits) - 1
    return d, (points[(code >> 2 * bits) & low] << 42) | (points[(code >> bits) & low] << 21) | points[code & low], rank


def predict(docs: DataFrame, found: DataFrame, size: int = 300, most_languages: int = 3000) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, held_out, text). More than ``most_languages`` profiles are
    an error, as all of them reach every task; none is left out."""
    if found.select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    rows = found.collect()  # ``size`` rows for each of these languages
    langs = sorted({r["lang"] for r in rows})
    grams = np.array(sorted({r["gram"] for r in rows}), dtype=np.int64)
    place = np.full((len(langs), len(grams) + 1), -1, dtype=np.int64)
    for r in rows:
        place[langs.index(r["lang"]), np.searchsorted(grams, r["gram"])] = r["rank"]
    model = docs.sparkSession.sparkContext.broadcast((langs, grams, place))

    def block(texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, grams, place = model.value
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        own = [i for i, t in enumerate(texts) if t]
        if not langs or not own:
            return names, scores
        d, gram, rank = _ranked([texts[i] for i in own], size)
        if not len(d):
            return names, scores
        at = np.searchsorted(grams, gram)
        at[(at == len(grams)) | (grams[np.minimum(at, len(grams) - 1)] != gram)] = len(grams)
        theirs = place[:, at]
        out = np.where(theirs < 0, size, np.abs(theirs - rank))
        n = np.bincount(d, minlength=len(own))
        far = np.stack([np.bincount(d, weights=o, minlength=len(own)) for o in out])
        best = far.argmin(0)
        for k, i in enumerate(own):
            if n[k]:
                names[i], scores[i] = langs[best[k]], float(1 - far[best[k], k] / (n[k] * size))
        return names, scores

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, names, scores = b.column("text").to_pylist(), [], []
            for some in _blocks(texts):
                x, y = block([texts[i] for i in some])
                names += x
                scores += y
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(task, "doc_id long, held_out boolean, lang_pred string, score double")
