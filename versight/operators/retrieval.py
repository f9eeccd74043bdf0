"""Hybrid retrieval: lexical, vector, character, event, density and temporal parts.

The exact score needs every pair of a work item and a chunk (a chunk without a common token can
still score). Items are few: they are counted, and taken in blocks of ``BROADCAST_ITEMS`` at
most. A block's items are matrices that go to the tasks; each task multiplies them with its
chunks' features in Arrow batches and returns, for each claim, only its own k best chunks.
So no pair is shuffled, and what is, is k rows a claim and task. A first pass takes the greatest
lexical and vector score of each item, by which the second divides. A claim's chunks below the k best of the task so far
are left after the sum of their parts; the others are scored part by part. Tokens become numbers in one
pass over the texts, in which distinct tokens alone are looked up and hashed. Texts come back after the top-k.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from versight import lexicons as L
from versight.functions import text as T
from versight.functions.store import written
from versight.operators import bm25

BROADCAST_ITEMS = 20_000
#: Best chunks of all claims that are sent to all tasks at most; each brings two neighbours.
BROADCAST_BEST = 100_000
ITEM = ("example_id", "claim_id", "item_idx")


def character_score(target: Column, mentions: Column, text: Column) -> Column:
    """1 for a mention of the name or of a part of a slashed name, 0.8 for a substring."""
    low, said = F.lower(target), F.transform(mentions, lambda m: F.lower(m))
    parts = F.filter(F.transform(F.split(low, "/"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(target.isNull() | (target == ""), 0.0).when(F.array_contains(said, low) | (low.contains("/") & F.arrays_overlap(parts, said)), 1.0).when(F.lower(text).contains(low), 0.8).otherwise(0.0)


def chunk_signals(events: Column, text: Column, signals=L.SIGNALS) -> Column:
    """map<event type, score>: 1 for a category in the chunk's events, and 0.6 for a term in its text, which is lower-cased once."""
    said = F.transform(events, lambda e: F.lower(e))

    def table(low: Column) -> Column:
        pairs = []
        for name, (categories, terms) in signals.items():
            category = F.arrays_overlap(said, T.literal_array(list(dict.fromkeys((name, *categories)))))
            term = reduce(lambda a, b: a | b, (low.contains(t) for t in terms), F.lit(False))
            pairs += [F.lit(name), F.when(category, 1.0).otherwise(0.0) + F.when(term, 0.6).otherwise(0.0)]
        return F.create_map(*pairs)

    return T.let(F.lower(text), table)


def inferred_types(query: Column, signals=L.SIGNALS) -> Column:
    """Event types with a term in the query, in the table's order."""
    low = F.lower(query)
    return F.filter(F.array(*(F.when(reduce(lambda a, b: a | b, (low.contains(t) for t in terms), F.lit(False)), name) for name, (_, terms) in signals.items())), lambda x: x.isNotNull())


def event_score(types: Column, signal_map: Column, events: Column, text: Column) -> Column:
    """Mean signal of the desired types, at most 1; a type outside the table stands for itself."""
    said, low = F.transform(events, lambda e: F.lower(e)), F.lower(text)
    one = lambda table: lambda t: F.coalesce(F.element_at(table, F.lower(t)), F.when(F.array_contains(said, F.lower(t)), 1.0).otherwise(0.0) + F.when(low.contains(F.lower(t)), 0.6).otherwise(0.0))
    mean = lambda table: F.least(F.aggregate(F.transform(types, one(table)), F.lit(0.0), lambda a, x: a + x) / F.size(types), F.lit(1.0))
    return F.when(F.size(types) > 0, T.let(signal_map, mean)).otherwise(0.0)


def temporal_cue(text: Column, terms=L.TEMPORAL_CUES) -> Column:
    return F.least(F.size(F.array_intersect(T.tokenise(text), T.literal_array(terms))) / 3.0, F.lit(1.0))


PARTS = tuple(L.WEIGHTS)
#: The switch of each part whose name is another.
SWITCH = {"bm25": "lexical", "incompatible": "event", "temporal": "timeline"}
#: The columns of the parts.
SCORES = tuple(f"{p}_score" for p in PARTS)


def _event_names(asked: DataFrame) -> list[str]:
    """All event types that items ask for or against, lower-cased, in a fixed order; a chunk's signals of others are never met."""
    own = asked.select(F.explode(F.concat("types", "against_types")).alias("t")).select(F.lower("t").alias("t")).distinct().collect()
    return sorted(r.t for r in own if r.t is not None)


def chunk_features(chunks: DataFrame, names: list[str], targets: list[str], *, signals=L.SIGNALS) -> DataFrame:
    """One narrow row per chunk: tokens, density, a signal for each event name and a score for each target."""
    events, text = F.col("event_mentions"), F.lower("text")
    said = F.transform(events, lambda e: F.lower(e))

    signals = {n: s for n, s in signals.items() if n in names}

    def one(table: Column) -> Column:
        return F.array(*(table[n] if n in signals else F.when(F.array_contains(said, n), 1.0).otherwise(0.0) + F.when(text.contains(n), 0.6).otherwise(0.0) for n in names)) if names else F.expr("cast(array() as array<double>)")

    met = F.array(*(character_score(F.lit(t), F.col("character_mentions"), text) for t in targets)) if targets else F.expr("cast(array() as array<double>)")
    return chunks.select("chunk_index_global", T.tokenise(F.coalesce("text", F.lit(""))).alias("tokens"), F.least(F.coalesce("plot_density_score", F.lit(0.0)) / 50.0, F.lit(1.0)).alias("density"), (T.let(chunk_signals(events, F.col("text"), signals), one) if signals else one(None)).alias("events"), met.alias("targets"))

#: Features that are taken over as they are.
FEATURES = ("chunk_index_global", "density", "events", "targets")

#: Buckets of the hashed vectors.
DIMS = 32
#: Terms of a block whose postings are a dense matrix at most.
DENSE_TERMS = 256
#: What rounding to six digits may move two scores.
MARGIN = 2e-6


class _Block:
    """The items of a block as matrices, and the scores of a batch of chunks against them."""

    def __init__(self, rows: list, names: list[str], targets: list[str], idf: dict[str, float], share: dict[str, float], average: float, on: dict[str, bool], terms: dict[str, int]):
        self.on, self.average = on, average or 1.0
        self.rows = sorted(rows, key=lambda r: (r.example_id, r.claim_id, r.item_idx))
        n, column, place = len(self.rows), {x: i for i, x in enumerate(names)}, {x: i for i, x in enumerate(targets)}
        self.vectors = _unit(np.array([r.qvec for r in self.rows]))
        wanted, against = np.zeros((n, len(names))), np.zeros((n, len(names)))
        for matrix, field in ((wanted, "types"), (against, "against_types")):
            for i, r in enumerate(self.rows):
                for t in r[field]:
                    matrix[i, column[t.lower()]] += 1
        opposed = np.array([r.channel.startswith(("contradiction", "incompatible")) for r in self.rows])
        target = np.array([place.get(r.character, -1) for r in self.rows])
        # items that differ in their query alone share a profile
        same = np.column_stack([target, opposed, wanted, against])
        kinds, self.profile = np.unique(same, axis=0, return_inverse=True)
        self.profile = self.profile.reshape(-1)
        self.target, self.opposed = kinds[:, 0].astype(int), kinds[:, 1] > 0
        self.wanted, self.against = kinds[:, 2 : 2 + len(names)], kinds[:, 2 + len(names) :]
        self.n_wanted, self.n_against = (np.maximum(1, m.sum(1)) for m in (self.wanted, self.against))
        self._postings(idf, share, terms)
        keys = [(r.example_id, r.claim_id) for r in self.rows]
        self.claims = list(dict.fromkeys(keys))
        self.starts = np.array([i for i in range(n) if i == 0 or keys[i] != keys[i - 1]])
        self.sizes = np.diff(np.append(self.starts, n))

    def _postings(self, idf: dict[str, float], share: dict[str, float], terms: dict[str, int]) -> None:
        """term -> items and multiplicity * idf: lists one after another, and a matrix of the terms that would be met most."""
        found: dict[str, dict[int, float]] = {}
        for i, r in enumerate(self.rows):
            for t in r.tokens:
                if t in idf:
                    own = found.setdefault(t, {})
                    own[i] = own.get(i, 0.0) + idf[t]
        # a term's number here, by that of all items' terms
        self.local = np.full(len(terms) + 1, -1)
        for i, t in enumerate(found):
            self.local[terms[t]] = i
        self.ends = np.cumsum([0, *(len(x) for x in found.values())])
        self.items = np.array([i for x in found.values() for i in x], np.int64)
        self.weights = np.array([w for x in found.values() for w in x.values()], float)
        met = np.array([len(x) * share[t] for t, x in found.items()])
        most = np.argsort(-met, kind="stable")[:DENSE_TERMS]
        most = most[met[most] > len(self.rows) / 200]
        self.dense_of = np.full(len(found) + 1, -1)
        self.dense_of[most] = np.arange(len(most))
        self.dense = np.zeros((len(most), len(self.rows)))
        for d, t in enumerate(most):
            self.dense[d, self.items[self.ends[t] : self.ends[t + 1]]] = self.weights[self.ends[t] : self.ends[t + 1]]

    def places(self, mask: np.ndarray | None) -> list[int]:
        """item_idx of each item: its own, or its place among those of its claim that the mask has."""
        if mask is None:
            return [r.item_idx for r in self.rows]
        ends = np.cumsum(mask)
        claim = np.searchsorted(self.starts, np.arange(len(self.rows)), side="right") - 1
        before = np.where(self.starts > 0, ends[self.starts - 1], 0)
        return (ends - 1 - before[claim]).tolist()

    def lexical(self, x: dict) -> np.ndarray:
        n, size = len(self.rows), x["size"]
        if not self.on["lexical"]:
            return np.zeros((size, n))
        scale = bm25.K1 * (1 - bm25.B + bm25.B * x["length"] / self.average)
        value = x["tf"] * (bm25.K1 + 1) / (x["tf"] + scale[x["row"]])
        at = self.dense_of[x["term"]]
        row, term, rest = x["row"][at < 0], x["term"][at < 0], value[at < 0]
        count = self.ends[term + 1] - self.ends[term]
        own = np.repeat(self.ends[term] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        out = np.bincount(np.repeat(row * n, count) + self.items[own], np.repeat(rest, count) * self.weights[own], size * n).astype(float, copy=False).reshape(size, n)
        if len(self.dense):
            often = np.zeros((size, len(self.dense)))
            often[x["row"][at >= 0], at[at >= 0]] = value[at >= 0]
            out += often @ self.dense
        return out

    def semantic(self, x: dict) -> np.ndarray:
        return x["vec"] @ self.vectors.T if self.on["semantic"] else np.zeros((x["size"], len(self.rows)))

    def profiles(self, x: dict) -> dict[str, np.ndarray]:
        """The parts that don't depend on the query, as (chunk, profile), and ``met``, the character's score."""
        size = x["size"]
        met = np.concatenate([x["targets"], np.zeros((size, 1))], 1)[:, self.target]
        event = lambda w, n: np.minimum(x["events"] @ w.T / n, 1.0)
        return {
            "met": met,
            "character": met,
            "event": event(self.wanted, self.n_wanted),
            "incompatible": np.where(self.opposed, event(self.against, self.n_against), 0.0),
            "density": np.broadcast_to(x["density"][:, None], met.shape),
            "temporal": np.broadcast_to(x["temporal"][:, None], met.shape),
        }


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors * vectors).sum(1))[:, None]
    return np.divide(vectors, norm, out=np.zeros(vectors.shape), where=norm > 0)


def _buckets(words: list[str], synonyms: dict[str, str], known: dict[str, int]) -> np.ndarray:
    """Each word's bucket, as ``T.hashed_embedding`` has it."""
    for w in words:
        if w not in known:
            known[w] = int(hashlib.md5(synonyms.get(w, w).encode()).hexdigest()[:8], 16) % DIMS
    return np.fromiter((known[w] for w in words), np.int64, len(words))


def _numbers(words: list[str], known: dict[str, int]) -> np.ndarray:
    return np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))


def _encoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(length of each row, row of each token, its number in the batch, the distinct tokens)."""
    length = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column).dictionary_encode()
    return length, np.repeat(np.arange(len(length)), length), flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist()


def _lists(row: np.ndarray, values: np.ndarray, size: int) -> pa.Array:
    """The values of each row, whose numbers ascend, as array<int>."""
    ends = np.append(0, np.cumsum(np.bincount(row, minlength=size)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def _coded(terms: dict[str, int], synonyms: dict[str, str]):
    """Features with numbers in place of tokens: those of ``terms`` with how often they occur, tokens by bucket, temporal cues."""
    cues = {t: i for i, t in enumerate(L.TEMPORAL_CUES)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            size = batch.num_rows
            length, row, code, words = _encoded(batch.column("tokens"))
            counts = np.bincount(row * DIMS + _buckets(words, synonyms, known)[code], minlength=size * DIMS)
            if len(known) > 1 << 20:
                known.clear()
            said, term = _numbers(words, cues)[code], _numbers(words, terms)[code]
            cued = np.unique(row[said >= 0] * len(cues) + said[said >= 0]) // len(cues)
            pairs, tf = np.unique(row[term >= 0] * len(terms) + term[term >= 0], return_counts=True)
            row_of, term_of = np.divmod(pairs, max(1, len(terms)))
            made = {"n_tokens": pa.array(length, pa.int32()), "temporal": pa.array(np.minimum(np.bincount(cued, minlength=size) / 3.0, 1.0)), "terms": _lists(row_of, term_of, size), "tfs": _lists(row_of, tf, size), "counts": _lists(np.repeat(np.arange(size), DIMS), counts, size)}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in FEATURES), *made.values()], names=[*FEATURES, *made])

    return run


def _parts(batches: Iterator[pa.RecordBatch], block: _Block, step: int, whole: bool = True) -> Iterator[dict]:
    """``step`` chunks at a time as arrays: vectors and the block's terms, and (``whole``) the other features."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            size = part.num_rows
            number = lambda c: part.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            flat = lambda c: pc.list_flatten(part.column(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            term = block.local[flat("terms")]
            row = np.repeat(np.arange(size), pc.list_value_length(part.column("terms")).to_numpy(zero_copy_only=False))
            x = {"size": size, "length": number("n_tokens"), "row": row[term >= 0], "term": term[term >= 0], "tf": flat("tfs")[term >= 0], "vec": _unit(flat("counts").reshape(size, DIMS).astype(float))}
            if whole:
                x |= {"temporal": number("temporal"), "density": number("density"), "events": flat("events").reshape(size, -1), "targets": flat("targets").reshape(size, -1), "at": number("chunk_index_global")}
            yield x


def best_chunks(items: DataFrame, chunks: DataFrame, k: int, *, strict_characters: bool = False, flags: dict[str, bool] | None = None, synonyms=L.SYNONYMS, signals=L.SIGNALS, batch_cells: int = 1 << 20, variants: dict[str, tuple[dict[str, bool], tuple[str, ...] | None]] | None = None) -> DataFrame:
    """The k best chunks of each claim, of those with a positive score: ids, rank, item_idx, channel, the parts and final_score.

    A chunk counts with the best of the claim's items, the earliest on ties; tied chunks keep
    the order in which items first reach them, then the corpus order. ``flags`` switches parts
    off: lexical, semantic, character, event, timeline. BM25 and vector scores are divided by
    their greatest value per item over all chunks, before any filter on characters.

    ``variants`` asks for several weightings at once: name -> (flags, channels of items that it has, None for all). The parts are
    computed once for all; a column ``variant`` tells the rows apart, whose item_idx counts the variant's own items.
    """
    ways = list((variants or {"": ({}, None)}).values())
    on = {"lexical": True, "semantic": True, "character": True, "event": True, "timeline": True} | (flags or {})
    spark, total = items.sparkSession, items.count()
    terms = {r[0]: i for i, r in enumerate(items.select(F.explode(T.tokenise(F.coalesce("query", F.lit("")))).alias("token")).distinct().collect())}
    targets = sorted(r[0] for r in items.select("character").distinct().collect() if r[0])
    types = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(inferred_types(F.col("query"), signals))
    asked = items.select(*ITEM, "character", "channel", T.tokenise(F.coalesce("query", F.lit(""))).alias("tokens"), T.hashed_embedding(F.col("query"), synonyms).alias("qvec"), types("event_types").alias("types"), types("incompatible_event_types").alias("against_types"))
    names = _event_names(asked)
    kinds, chunk_kind = dict(items.dtypes), dict(chunks.dtypes)["chunk_index_global"]
    features = chunk_features(chunks, names, targets, signals=signals).mapInArrow(_coded(terms, synonyms), f"chunk_index_global {chunk_kind}, density double, events array<double>, targets array<double>, n_tokens int, temporal double, terms array<int>, tfs array<int>, counts array<int>")
    features = written(features, "features")
    lengths = features.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("avgdl")).first()
    words = list(terms)
    df = {words[r.term]: r.df for r in features.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    idf = {t: math.log(1 + (lengths.n - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    share = {t: n / lengths.n for t, n in df.items()}
    blocks, out = -(-total // BROADCAST_ITEMS), None
    for b in range(blocks):
        # a claim's items stay together
        part = asked.where(F.pmod(F.xxhash64("example_id", "claim_id"), F.lit(blocks)) == b) if blocks > 1 else asked
        block = _Block(part.collect(), names, targets, idf, share, lengths.avgdl, on, terms)
        if not block.rows:
            continue
        sent = spark.sparkContext.broadcast(block)
        step = max(1, batch_cells // len(block.rows))

        def greatest(batches, sent=sent, step=step):
            most = np.full((2, len(sent.value.rows)), -np.inf)
            for x in _parts(batches, sent.value, step, False):
                most = np.maximum(most, [sent.value.lexical(x).max(0), sent.value.semantic(x).max(0)])
            seen = np.flatnonzero(np.isfinite(most[0]))
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(most[0][seen]), pa.array(most[1][seen])], names=["i", "b", "s"])

        most = np.zeros((2, len(block.rows)))
        for r in features.select("n_tokens", "terms", "tfs", "counts").mapInArrow(greatest, "i long, b double, s double").groupBy("i").agg(F.max("b").alias("b"), F.max("s").alias("s")).collect():
            most[:, r.i] = r.b, r.s

        masks = [(own, None if only is None else np.array([r.channel in only for r in block.rows])) for own, only in ways]

        def pick(batches, sent=sent, step=step, most=most, masks=masks):
            yield from _picked(batches, sent.value, step, most, strict_characters, k, masks)

        schema = f"claim int, item int, first_item int, chunk_index_global {chunk_kind}, " + ", ".join(f"{c} double" for c in (*SCORES, "final_score"))
        near = features.mapInArrow(pick, schema)
        order = W.partitionBy("claim").orderBy(F.desc("final_score"), "first_item", "chunk_index_global")
        near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        rows = [(v, i, r.example_id, r.claim_id, place, r.channel) for v, (_, mask) in enumerate(masks) for i, r, place in zip(range(len(block.rows)), block.rows, block.places(mask), strict=True)]
        owner = spark.createDataFrame(rows, f"v int, item int, example_id {kinds['example_id']}, claim_id {kinds['claim_id']}, item_idx int, channel string")
        near = near.withColumn("v", F.floor(F.col("claim") / len(block.claims)).cast("int"))
        named = [F.get(T.literal_array(list(variants)), F.col("v")).alias("variant")] if variants else []
        done = written(near.join(F.broadcast(owner), ["v", "item"]).select(*named, "example_id", "claim_id", "item_idx", "channel", "chunk_index_global", *SCORES, "final_score", "rank"), "best")
        sent.unpersist()
        out = done if out is None else out.unionByName(done)
    if out is None:
        columns = ", ".join([*(["variant string"] if variants else []), f"example_id {kinds['example_id']}, claim_id {kinds['claim_id']}, item_idx int, channel string, chunk_index_global {chunk_kind}", *(f"{c} double" for c in (*SCORES, "final_score")), "rank int"])
        return spark.createDataFrame([], columns)
    return out


def _picked(batches, block: _Block, step: int, most: np.ndarray, strict: bool, k: int, variants: list):
    """The k best chunks of each claim and variant among a task's chunks: a batch's candidates are merged with the best so far."""
    kept, claims = None, len(block.claims)
    least = np.zeros((len(variants), claims))  # what a chunk has to reach
    down = np.divide(1.0, most, out=np.zeros_like(most), where=most > 0)
    for x in _parts(batches, block, step):
        lexical, semantic, base = block.lexical(x), block.semantic(x), block.profiles(x)
        fresh = []
        for v, (switched, mask) in enumerate(variants):
            on = {p: (block.on | switched).get(SWITCH.get(p, p), True) for p in PARTS}
            own = sum((L.WEIGHTS[p] * base[p] for p in PARTS if p in base and on[p]), np.zeros(base["met"].shape))
            if strict:
                own = np.where((base["met"] > 0) | (block.target < 0), own, -10.0)
            total = own[:, block.profile]
            for p, score, d in (("bm25", lexical, down[0]), ("semantic", semantic, down[1])):
                if on[p]:
                    total += score * (L.WEIGHTS[p] * d)
            if mask is not None:
                total[:, ~mask] = -10.0
            best = np.maximum.reduceat(total, block.starts, axis=1)
            low = least[v]
            if x["size"] >= k:
                low = np.maximum(low, np.partition(best, x["size"] - k, axis=0)[x["size"] - k] - MARGIN)
            row, claim = np.nonzero((best >= low) & (best > 0))
            many = max(1, (1 << 20) // int(block.sizes.max()))
            for at in range(0, len(row), many):
                fresh.append(_exact(block, x, row[at : at + many], claim[at : at + many], lexical, semantic, base, most, on, mask, strict, v * claims))
        if not fresh:
            continue
        kept = tuple(np.concatenate(a) for a in zip(*([kept] if kept is not None else []), *fresh, strict=True))
        order = np.lexsort((kept[3], kept[2], -kept[4][:, -1], kept[0]))
        claim = kept[0][order]
        place = np.arange(len(order)) - np.searchsorted(claim, claim)
        kept = tuple(a[order[place < k]] for a in kept)
        full = place[place < k] == k - 1
        least.reshape(-1)[kept[0][full]] = kept[4][full, -1] - MARGIN
    if kept is not None:
        yield pa.RecordBatch.from_arrays([pa.array(kept[0].astype(np.int32)), pa.array(kept[1].astype(np.int32)), pa.array(kept[2].astype(np.int32)), pa.array(kept[3]), *(pa.array(kept[4][:, j]) for j in range(kept[4].shape[1]))], names=["claim", "item", "first_item", "chunk_index_global", *SCORES, "final_score"])


def _exact(block: _Block, x: dict, row: np.ndarray, claim: np.ndarray, lexical: np.ndarray, semantic: np.ndarray, base: dict, most: np.ndarray, on: dict[str, bool], mask: np.ndarray | None, strict: bool, shift: int) -> tuple:
    """(claim, item, first item with a score, chunk, parts and final score) of chunks and claims: the best of the claim's items, the earliest on ties."""
    along = np.arange(block.sizes[claim].max())
    there = along < block.sizes[claim][:, None]
    item, row = np.where(there, block.starts[claim][:, None] + along, block.starts[claim][:, None]), row[:, None]
    scaled = lambda score, m: np.maximum(np.divide(score, m, out=np.zeros_like(score), where=m > 0), 0.0)
    parts = {p: np.zeros(item.shape) for p in PARTS}
    for p in PARTS:
        if on[p]:
            parts[p] = scaled(lexical[row, item], most[0][item]) if p == "bm25" else scaled(semantic[row, item], most[1][item]) if p == "semantic" else base[p][row, block.profile[item]]
    final = sum(L.WEIGHTS[p] * parts[p] for p in PARTS)
    if strict:
        final = np.where((base["met"][row, block.profile[item]] > 0) | (block.target[block.profile[item]] < 0), final, -1.0)
    final = np.where(there if mask is None else there & mask[item], np.round(final, 6), -1.0)
    best = final.argmax(1)
    all_of = np.arange(len(best))
    good = np.flatnonzero(final[all_of, best] > 0)
    values = np.column_stack([*(np.round(parts[p][all_of, best], 6) for p in PARTS), final[all_of, best]])[good]
    return shift + claim[good], item[all_of, best][good], (final > 0).argmax(1)[good], x["at"][row[good, 0]], values


def with_neighbours(top: DataFrame, chunks: DataFrame, factor: float = 0.65) -> DataFrame:
    """Adds the chunks before and after in the chapter, each claimed by the best ranked that reaches it.

    A neighbour has the item of its parent and no score of its own parts. The best chunks are few and are sent to the chunks,
    of which none is shuffled, unless there are more than ``BROADCAST_BEST``.
    """
    small = F.broadcast if top.count() <= BROADCAST_BEST else lambda x: x
    claim = ["example_id", "claim_id"]
    item = [c for c in ("item_idx",) if c in top.columns]
    parts = [c for c in SCORES if c in top.columns]
    place = chunks.select("chunk_index_global", "book_name", "chapter_id", "chunk_index_in_chapter")
    reach = top.select(*claim, *item, "channel", "rank", "final_score", F.col("chunk_index_global").alias("parent"))
    reach = place.withColumnRenamed("chunk_index_global", "parent").join(small(reach), "parent")
    reach = reach.select("*", F.explode(F.array(F.struct(F.lit(0).alias("o"), (F.col("chunk_index_in_chapter") - 1).alias("at")), F.struct(F.lit(1).alias("o"), (F.col("chunk_index_in_chapter") + 1).alias("at")))).alias("x")).select(*claim, *item, "channel", "rank", "final_score", "parent", "book_name", "chapter_id", "x.*")
    near = place.withColumnRenamed("chunk_index_in_chapter", "at").join(small(reach), ["book_name", "chapter_id", "at"]).join(top.select(*claim, "chunk_index_global"), [*claim, "chunk_index_global"], "left_anti")
    near = near.withColumn("n", F.row_number().over(W.partitionBy(*claim, "chunk_index_global").orderBy("rank", "o"))).where("n = 1")
    near = near.select(*claim, *item, *(F.lit(None).cast("double").alias(c) for c in parts), "chunk_index_global", F.concat("channel", F.lit(":neighbor")).alias("channel"), F.round(F.col("final_score") * factor, 6).alias("final_score"), F.lit("neighbor_expansion").alias("source"), "parent", F.col("rank").cast("long").alias("p1"), F.col("o").cast("long").alias("p2"))
    own = top.select(*claim, *item, *parts, "chunk_index_global", "channel", "final_score", F.lit("retrieval").alias("source"), F.lit(None).cast(dict(top.dtypes)["chunk_index_global"]).alias("parent"), F.col("rank").cast("long").alias("p1"), F.lit(-1).cast("long").alias("p2"))
    both = own.unionByName(near)
    order = [F.desc("final_score"), F.when(F.col("source") == "retrieval", 0).otherwise(1), "p1", "p2"]
    return both.withColumn("rank", F.row_number().over(W.partitionBy(*claim).orderBy(*order))).drop("p1", "p2")


def retrieve(items: DataFrame, chunks: DataFrame, *, k: int = 10, **options) -> DataFrame:
    """Top chunks of each claim with neighbours: ids, rank, channel, scores, the item's query and family, and the chunk's text."""
    return completed(best_chunks(items, chunks, k, **options), items, chunks)


def completed(best: DataFrame, items: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks of ``best_chunks`` (of one variant) with neighbours, their items' queries and their texts."""
    found = written(with_neighbours(best, chunks), "neighbours")
    found = found.join(items.select(*ITEM, "query", "family_name"), list(ITEM), "left")
    small = F.broadcast if best.count() <= BROADCAST_BEST else lambda x: x
    return small(found).join(chunks.select("chunk_index_global", "chunk_id", "book_name", "chapter_id", "text"), "chunk_index_global")


def by_id(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks of the rows of ``ids`` (chunk_id), by a join; ids without a chunk are left out."""
    return ids.select("chunk_id").distinct().join(chunks, "chunk_id")


def keyword_overlap(query: Column, doc: Column) -> Column:
    """Words of the query (over two characters, repeats counted) that are substrings of the document."""
    return overlap(query_words(query), F.lower(doc))


def query_words(query: Column) -> Column:
    return F.filter(T.words(F.lower(query)), lambda w: F.length(w) > 2)


def overlap(words: Column, low: Column) -> Column:
    """How many of the words are part of a lower-cased text; both are made once, before pairs are."""
    return T.let(low, lambda x: F.size(F.filter(words, lambda w: x.contains(w))))


def top_structs(scored: DataFrame, keys: list[str], k: int, fields: list[str], *, by: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The k best rows of each key as an ordered array of structs."""
    ranked = scored.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(by), tie))).where(F.col("_n") <= k)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", *fields))).alias("top")).withColumn("top", F.transform("top", lambda x: F.struct(*(x[f].alias(f) for f in fields))))
