"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ORDER bytes is counted on a bounded sample of labelled rows. A
byte's probability comes from the longest context known to that language; a byte that the context hasn't shown
escapes to the next shorter one with probability d / (n + d) (n: bytes seen there, d: different ones), without the
bytes that the longer context would have predicted, and ends at a uniform choice of 256 bytes. Statistics are frozen, so
the code length of a byte depends only on its context. A text's score is the sum over all its bytes, and the
shortest code wins.

The model holds every context and every byte after it that any language has shown, with the exact cost in all
languages; a byte that no language has shown there costs the context's escape and then what it costs after the
shorter context. The contexts seen most often, as many as DENSE_BYTES hold, also have a row of a dense table, which only
saves time.

Defined results: a null text or one without a letter is ``und`` with score 0; a text that all languages code equally
long takes the first of them by name; without labelled rows every text is ``und``; every language with a labelled
row is learned; a text of any length is coded whole; labels that are null are not used; repeated rows repeat the
result; other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelake.llm.arrays import chunks, make_room
from edgelake.llm.shared import bound_batches

ORDER = 3
#: Labelled rows of a language that are counted, about; they are chosen by a hash of the text.
SAMPLE = 1_500
#: Bytes of the dense table.
DENSE_BYTES = 24 << 20
#: Bytes coded at once.
BLOCK = 1 << 18
UNKNOWN = np.int32(-1)


@dataclass
class Model:
    """Contexts of each order are numbered from 0 in ``place``; those over ``len(dense)`` of their order have no dense row."""

    languages: list[str]
    symbol: np.ndarray  # of each byte; the last symbol stands for all bytes never seen
    place: list[np.ndarray]  # by order: the number of a context, made of its symbols, or UNKNOWN
    escape: list[np.ndarray]  # by order: nats by (context, language)
    keys: list[np.ndarray]  # by order: context * symbols + symbol of what was shown, ascending
    shown: list[np.ndarray]  # by order: nats by (key, language)
    dense: list[np.ndarray]  # by order: nats by (context, symbol, language) of the first contexts

    def costs(self, code: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Nats by (position, language) of symbols s after contexts, numbers made of the last ORDER symbols."""
        size, n = int(self.symbol.max()) + 1, len(s)
        # most positions have a dense row of the longest order
        place = self.place[ORDER][code]
        dense = self.dense[ORDER]
        if len(dense):
            ok = (place >= 0) & (place < len(dense))
            out = dense.reshape(-1, dense.shape[2])[np.where(ok, place * size + s, 0)]
            todo = np.flatnonzero(~ok)
            out[todo] = 0
        else:
            out, todo = np.zeros((n, len(self.languages)), np.float32), np.arange(n)
        for k in range(ORDER, -1, -1):
            if not len(todo):
                break
            place, symbol = self.place[k][code[todo] % size**k], s[todo]
            rich = (place >= 0) & (place < len(self.dense[k]))
            out[todo[rich]] += self.dense[k][place[rich], symbol[rich]]
            known = (place >= 0) & ~rich
            key = place[known].astype(np.int64) * size + symbol[known]
            at = np.minimum(np.searchsorted(self.keys[k], key), max(len(self.keys[k]) - 1, 0))
            hit = self.keys[k][at] == key if len(self.keys[k]) else np.zeros(len(key), bool)
            out[todo[known][hit]] += self.shown[k][at[hit]]
            out[todo[known][~hit]] += self.escape[k][place[known][~hit]]
            todo = np.concatenate([todo[place < 0], todo[known][~hit]])
        return out

    def code_lengths(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Nats by text and language; each text follows blanks."""
        n, size = len(off) - 1, int(self.symbol.max()) + 1
        s = np.insert(self.symbol[raw].astype(np.int16), np.repeat(off[:-1], ORDER), self.symbol[0x20])
        starts = off[:-1] + ORDER * np.arange(n)  # of the blanks before each text
        out = np.zeros((n, len(self.languages)))
        for at in range(ORDER, len(s), BLOCK):
            to = min(at + BLOCK, len(s))
            c1, c2, c3 = (s[at - k : to - k].astype(np.int32) for k in (1, 2, 3))
            costs = self.costs((c3 * size + c2) * size + c1, s[at:to].astype(np.int32))
            a, b = np.searchsorted(starts, (at, to))
            blanks = (starts[max(a - 1, 0) : b, None] + np.arange(ORDER)).ravel() - at
            costs[blanks[(blanks >= 0) & (blanks < to - at)]] = 0
            heads = starts[a:b] - at
            if not len(heads) or heads[0]:
                heads, a = np.append(0, heads), a - 1
            out[a:b] += np.add.reduceat(costs, heads, 0, dtype=np.float64)
        return out


def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): occurrences of each byte after the three bytes before it, as one 32-bit number."""
    make_room()
    for rows, raw, off in chunks(batches, text=1):
        padded, last = [], rows.column(0).to_pylist()
        for i, lang in enumerate(last):
            b = np.concatenate([np.full(ORDER, 0x20, np.uint32), raw[off[i] : off[i + 1]].astype(np.uint32)])
            padded.append((lang, b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]))
        for lang in sorted(set(last)):
            values, n = np.unique(np.concatenate([g for k, g in padded if k == lang]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Count contexts on about ``sample`` rows of each language and build the model."""
    chosen, sizes = labelled(docs, text_col, lang_col, sample)
    if not sizes:
        return None
    counted = chosen.mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return build(counted.toPandas(), sorted(sizes))  # bounded by the sample


def labelled(docs: DataFrame, text_col: str, lang_col: str, sample: int) -> tuple[DataFrame, dict[str, int]]:
    """About ``sample`` rows (lang, text) of each language, and the labelled rows of each."""
    bound_batches(docs.sparkSession)
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    share = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / n))))) if sizes else F.lit(None).cast("map<string,double>")
    return known.where(F.pmod(F.xxhash64("text", F.lit("langid")), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * (1 << 30)), sizes


def rates(docs: DataFrame, model: Model | None, share: float = 0.999, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict[str, float]:
    """Nats a byte that ``share`` of the labelled sample's rows of each language don't exceed under their own language's model."""
    chosen, sizes = labelled(docs, text_col, lang_col, sample)
    if model is None or not sizes:
        return {}
    judged = predict(chosen, model, keep=["lang"], names=("_lang", "_score"), rate="_rate").where("lang = _lang")
    return {r["lang"]: r["rate"] for r in judged.groupBy("lang").agg(F.percentile_approx("_rate", share, 10_000).alias("rate")).collect()}


def tree_of(code: np.ndarray, n: np.ndarray, size: int) -> list[tuple]:
    """By order: (keys shown, nats, contexts, nats of their escapes) of one language; code holds the symbols of each gram, the byte last."""
    out: list[tuple] = []
    lower = None
    for k in range(ORDER + 1):
        keys, at = np.unique(code % size ** (k + 1), return_inverse=True)
        count = np.bincount(at, n, len(keys))
        context, at = np.unique(keys // size, return_inverse=True)
        total, different = np.bincount(at, count, len(context)), np.bincount(at, minlength=len(context)).astype(float)
        # of a byte shown here, the shorter context has shown it too
        p_lower = np.full(len(keys), 1 / 256) if lower is None else np.exp(-lower[1][np.searchsorted(lower[0], keys % size**k)])
        left = 1 - np.bincount(at, p_lower, len(context))
        open_ = left > 1e-9
        shown = -np.log(count / np.where(open_, total + different, total)[at])
        escape = np.where(open_, -np.log(different / (total + different)) + np.log(np.maximum(left, 1e-9)), 69.0)
        out.append((keys, shown, context, escape))
        lower = (keys, shown)
    return out


def costs_of(tree: list[tuple], k: int, keys: np.ndarray, size: int) -> np.ndarray:
    """Nats of any keys (context of k symbols and a symbol) in one language, by its own tree."""
    out, todo = np.zeros(len(keys)), np.arange(len(keys))
    for order in range(k, -1, -1):
        own, shown, context, escape = tree[order]
        key = keys[todo] % size ** (order + 1)
        at = np.minimum(np.searchsorted(own, key), len(own) - 1)
        hit = own[at] == key
        out[todo[hit]] += shown[at[hit]]
        todo, key = todo[~hit], key[~hit]
        at = np.minimum(np.searchsorted(context, key // size), len(context) - 1)
        out[todo] += np.where(context[at] == key // size, escape[at], 0)
    out[todo] += np.log(256)
    return out


def build(counted: pd.DataFrame, languages: list[str]) -> Model:
    """The model from counts of (lang, gram, n)."""
    gram = counted["gram"].to_numpy().astype(np.uint64)
    parts = [((gram >> np.uint64(s)) & np.uint64(255)).astype(np.int64) for s in (24, 16, 8, 0)]
    used = np.unique(np.concatenate([[0x20], *parts])).astype(np.int64)
    symbol = np.full(256, len(used), np.int32)
    symbol[used] = np.arange(len(used))
    size = len(used) + 1
    code = np.zeros(len(gram), np.int64)
    for part in parts:
        code = code * size + symbol[part]
    own, n = counted["lang"].to_numpy(), counted["n"].to_numpy().astype(float)
    trees = [tree_of(code[own == k], n[own == k], size) if (own == k).any() else tree_of(np.full(1, size - 1), np.ones(1), size) for k in languages]
    width = 4 * size * len(languages)
    budget = max(1 + size, DENSE_BYTES // width)  # dense rows; all of orders 0 and 1 have one
    place, escape, keys, shown, dense = [], [], [], [], []
    for k in range(ORDER + 1):
        every = np.unique(np.concatenate([tree[k][0] for tree in trees]))
        context, at = np.unique(every // size, return_inverse=True)
        often = np.zeros(len(context))
        own_keys, inverse = np.unique(code // size % size**k, return_inverse=True)
        often[np.searchsorted(context, own_keys[np.isin(own_keys, context)])] = np.bincount(inverse, n)[np.isin(own_keys, context)]
        order = np.lexsort((context, -often))  # the contexts seen most often come first
        number = np.empty(len(context), np.int32)
        number[order] = np.arange(len(context))
        table = np.full(size**k, UNKNOWN, np.int32)
        table[context] = number
        leave = np.zeros((len(context), len(languages)), np.float32)
        for i, tree in enumerate(trees):
            leave[number[np.searchsorted(context, tree[k][2])], i] = tree[k][3]
        cost = np.stack([costs_of(tree, k, every, size) for tree in trees], 1).astype(np.float32)
        key = number[at].astype(np.int64) * size + every % size
        sort = np.argsort(key)
        key, cost = key[sort], cost[sort]
        rows = min(len(context), budget)
        budget -= rows
        if k:
            shorter = place[k - 1][context[order[:rows]] % size ** (k - 1)]
            rows = int(np.argmax(np.append(shorter >= len(dense[k - 1]), True)))
            block = dense[k - 1][shorter[:rows]] + leave[:rows, None, :]
        else:
            block = np.full((1, size, len(languages)), np.log(256), np.float32) + leave[:1, None, :]
        mine = key < rows * size
        block.reshape(-1, len(languages))[key[mine]] = cost[mine]
        for kept, x in ((place, table), (escape, leave), (keys, key), (shown, cost), (dense, np.ascontiguousarray(block, np.float32))):
            kept.append(x)
    return Model(languages, symbol, place, escape, keys, shown, dense)


def predict(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score"), rate: str | None = None
) -> DataFrame:
    """Add ``names``, lang_pred and score (the posterior of the language under equal priors) to ``keep`` columns, or to the id; and ``rate``, nats a byte, if asked for."""
    keep = keep or [id_col]
    more = [rate] if rate else []
    letter = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))
    if model is None:
        return docs.select(*keep, F.lit("und").alias(names[0]), F.lit(0.0).alias(names[1]), *(F.lit(0.0).alias(k) for k in more))
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample and DENSE_BYTES
    fields = [docs.schema[k] for k in keep]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        own = shared.value
        labels = pa.array([*own.languages, "und"])
        for rows, raw, off in chunks(batches, text=0):
            nats = own.code_lengths(raw, off)
            best, low = nats.argmin(1), nats.min(1)
            score = 1 / np.exp(np.maximum(low[:, None] - nats, -700)).sum(1)
            ok = rows.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(i + 2) for i in range(len(keep))), labels.take(pa.array(np.where(ok, best, len(own.languages)))), pa.array(np.where(ok, score, 0.0)), pa.array(low / np.maximum(np.diff(off), 1))],
                [*(f"c{i}" for i in range(len(keep))), "lang_pred", "score", "rate"],
            )

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))
    out = docs.select(F.col(text_col).alias("_text"), letter.alias("_letter"), *(F.col(k).alias(f"c{i}") for i, k in enumerate(keep)))
    out = out.mapInArrow(work, f"{schema}, lang_pred string, score double, rate double")
    return out.toDF(*keep, *names, rate) if rate else out.drop("rate").toDF(*keep, *names)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; null ids aren't held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
