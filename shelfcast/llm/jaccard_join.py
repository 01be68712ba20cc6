"""N-gram Jaccard join by multiple-global-order prefix filters.

Documents are sets of word shingles. Under any one order of all shingles, two sets of Jaccard similarity t
share a shingle among the first n - ceil(t n) + 1 of each. ``orders`` orders are used: order i ranks
the i-th slice of the hash space first, then the other orders' slices, then the rest, rarest shingles first
in each. Document frequencies are counted in the orders' slices, and elsewhere among the documents whose
prefixes may reach that far, so every document ranks what it ranks by the same numbers. A pair is a candidate only
if its prefixes meet under every order; shingles that no other document has and histograms of the sets bound
their difference from below and sort out more, the cheaper bound while prefixes meet; the rest is verified on
the full sets.

Equal sets are one class and are represented by their least id. Links are found in steps so that
a group of near copies never emits all its pairs: first each class is verified against the pivot of
the bucket of its rarest shared shingle under each order, and components are formed; then, in rounds, each class that
shares buckets with other components offers a bounded number of pairs with their members, and components contract;
at last only pairs from different components that meet under all orders are verified, which loses no link between
components.

Few ids are sent to wide rows (prefixes, texts), not wide rows to them, and a table goes when the step that
reads it ends, so the disk holds the prefixes once and little else."""

from __future__ import annotations

import operator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, mix64, scratch_scope, scratch_table, text_bytes, text_chunks, word_hashes
from .runs import Runs, answers_of, ask, packed, run_of

_STEP = np.uint64(0x9E3779B97F4A7C15)
SLICES = 5      # an order's slice is this part of the hash space
SHORT = 200     # shingles; the frequencies of all shingles of shorter documents are counted
HISTOGRAM = 64  # cells of the histogram filter
CELLS = 8       # cells of the small histograms, of 8 bits each, that travel with the prefixes
BACK = 4        # shingles before a bucket's that are looked at for a meeting of the same pair
OFFERS = 12     # pairs that a class offers in a round
ROUND_YIELD = 20  # rounds go on while more than one of so many offered pairs links
FEW_BYTES = 8 << 20  # rows of ids up to this size are broadcast
BOUND = ["own", "own_rest", "n_rest", "counted", "cells", "cells_rest"]


def shingles(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, n + 1 offsets). Fewer words than ``width`` are one
    shingle; no words, none."""
    words, first = word_hashes(data, offs)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(words)) - np.repeat(first[:-1], n)
    size = np.minimum(n, width)  # words in a shingle of the text
    last = pos >= np.repeat(size, n) - 1
    h = np.zeros(len(words), np.uint64)
    for k in range(width):  # a text with fewer words stops at its first
        back = np.zeros(len(words), np.uint64)
        back[k:] = words[:len(words) - k] if k else words
        h = np.where(pos >= k, mix64(h * _STEP + back + np.uint64(k + 1)), h)
    h, doc = h[last], doc[last]
    at = np.lexsort((h, doc))
    h, doc = h[at], doc[at]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def all_shingles(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    data, offs = text_bytes(t.column("text"))
    parts = [shingles(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], width) for i, j in text_chunks(data, offs)]
    sizes = np.concatenate([np.zeros(0, np.int64), *[np.diff(p[1]) for p in parts]])
    return np.concatenate([np.zeros(0, np.uint64), *[p[0] for p in parts]]), np.concatenate([[0], np.cumsum(sizes)])


def slice_of(h: np.ndarray) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(SLICES)) >> np.uint64(32)).astype(np.int64)


def slice_keys(h: np.ndarray, i: int) -> np.ndarray:
    """Hashes of slice i spread over 64 bits again, in the same order, for even buckets."""
    return (h - np.uint64(-(-(i << 64) // SLICES))) * np.uint64(SLICES)


def least_common(n: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of a set of n with a set that it links to."""
    return -(-percent * n // 100)


def rarity(docs: np.ndarray) -> np.ndarray:
    """0 for a shingle of one document, else 1 + half powers of two of the number of documents."""
    return np.where(docs < 2, 0, 1 + np.minimum(np.floor(2 * np.log2(np.maximum(docs, 2))), 250)).astype(np.int64)


def prefixes(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, orders: int) -> DataFrame:
    """id, row (a number of its own), n, digest (of the set), hist (histogram of the set), p0.. (each order's prefix,
    without shingles that only this document has; the first is the rarest), and what bounds the difference of two sets
    (``least_difference``): counted (whether all shingles' frequencies are known), own and own_rest (shingles that no
    other counted document has, in the orders' slices and elsewhere), n_rest (all shingles elsewhere), cells
    and cells_rest (small histograms of the other shingles of either kind)."""
    runs = Runs(docs, id_col, text_col)

    def asked(h: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shingles whose frequency is counted, documents of which all are): those of the orders' slices, and all of
        a document that is short or may need others for its prefix. A prefix never reaches a shingle that was
        not asked for."""
        n = np.diff(at)
        doc = np.repeat(np.arange(len(n)), n)
        inside = np.bincount(doc[which < orders], minlength=len(n))
        every = (n < SHORT) | (inside < n - least_common(n, percent) + 1)
        return (which < orders) | every[doc], every

    def keys_of(t: pa.Table):
        h, at = all_shingles(t, width)
        which = slice_of(h)
        (on, _), out = asked(h, at, which), {}
        for i in range(SLICES):
            u, n = np.unique(slice_keys(h[on & (which == i)], i), return_counts=True)
            out[i] = u, {"docs": n}
        return out

    def choose(t: pa.Table, a: pa.Table) -> pa.Table:
        h, at = all_shingles(t, width)
        n = np.diff(at)
        doc = np.repeat(np.arange(len(n)), n)
        which = slice_of(h)
        keep = n - least_common(n, percent) + 1
        cols = {"id": t.column("id"), "row": pa.array(np.arange(len(n)) + ((run_of(t) << 32) if len(n) else 0)), "n": pa.array(n.astype(np.int64))}
        some = np.minimum(at[:-1], max(len(h) - 1, 0))
        sums = [np.where(n > 0, np.add.reduceat(x, some), np.uint64(0)) if len(h) else np.zeros(len(n), np.uint64)
                for x in (mix64(h ^ _STEP), mix64(h + _STEP))]
        cols["digest"] = pa.array([packed(np.array([x, y, k], np.uint64)) for x, y, k in zip(*sums, n.astype(np.uint64))], pa.binary())
        cell = (doc * HISTOGRAM + (mix64(h) >> np.uint64(58)).astype(np.int64)) if len(h) else np.zeros(0, np.int64)
        hist = np.bincount(cell, minlength=len(n) * HISTOGRAM).reshape(len(n), HISTOGRAM)
        cols["hist"] = pa.array([packed(x) for x in np.minimum(hist, 65535).astype(np.uint16)], pa.binary())
        on, every = asked(h, at, which)
        common = np.zeros(len(h), np.int64)
        for i in range(SLICES):
            own = on & (which == i)
            u, index = np.unique(slice_keys(h[own], i), return_inverse=True)
            common[own] = answers_of(a, i, "rarity")[index]
        inner, single = which < orders, on & (common == 0)
        count = lambda sel: np.bincount(doc[sel], minlength=len(n))
        small = (mix64(h) >> np.uint64(61)).astype(np.int64)

        def cells(sel: np.ndarray) -> pa.Array:
            c = np.bincount(doc[sel] * CELLS + small[sel], minlength=len(n) * CELLS).reshape(len(n), CELLS)
            return pa.array(np.minimum(c, 255).astype(np.uint8).reshape(-1).view(np.int64))
        cols |= {"own": pa.array(count(inner & single)), "own_rest": pa.array(count(~inner & single)), "n_rest": pa.array(count(~inner)),
                 "counted": pa.array(every), "cells": cells(inner & ~single), "cells_rest": cells(~inner & ~single)}
        for i in range(orders):
            # the order's slice, the other orders' slices, the rest; by rarity in each, ties by a salted hash
            cls = np.where(which == i, 0, np.where(which < orders, 1000, np.where(on, 2000, 3000))) + common
            order = np.lexsort((mix64(h + mix64(np.array([i + 1], np.uint64))), cls, doc))
            rank = np.arange(len(h)) - at[doc]
            take = (rank < keep[doc]) & (common[order] > 0)
            chosen = h[order][take]
            ends = np.searchsorted(doc[take], np.arange(len(n) + 1))
            cols[f"p{i}"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(chosen.view(np.int64)))
        return pa.table(cols)

    schema = (f"id {runs.id_type}, row long, n long, digest binary, hist binary, own long, own_rest long, n_rest long, counted boolean, "
              "cells long, cells_rest long") + "".join(f", p{i} array<long>" for i in range(orders))
    with scratch_scope(docs.sparkSession) as keep:
        answers = ask(runs, keys_of, ("docs",), lambda sums: {"rarity": rarity(sums["docs"])}, ("rarity",), runs.buckets(0.17 / SLICES), "shingle_rarity")
        return keep(runs.apply_with(answers, choose, schema), "prefixes")


def few(table: DataFrame) -> DataFrame:
    """``table`` of ids, marked for broadcast if it is small."""
    return broadcast_if_small(table, 50, FEW_BYTES)


def rows_in(rows: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """The rows whose id is in one of ``pairs`` (written, known to be ``most`` at most)."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    return rows.join(F.broadcast(ids) if most * 100 <= FEW_BYTES or pairs.count() * 100 <= FEW_BYTES else ids, "id", "left_semi")


def set_rows(docs: DataFrame, width: int) -> DataFrame:
    """id, set: the sorted distinct shingle hashes of each (id, text) as bytes."""
    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                h, at = all_shingles(pa.table({"text": part.column(1)}), width)
                sets = [packed(h[i:j]) for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["id", "set"])
    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, set binary")


def least_difference(x: str = "", y: str = "2") -> Column:
    """A lower bound of the size of the symmetric difference of two sets by the columns of ``BOUND`` with the two
    suffixes. Shingles that no other document has count in full, the others by the L1 distance of histograms,
    whose cells are cut at 255, which never lengthens a distance. Outside the orders' slices this holds between
    documents of one kind, else only the numbers of shingles are compared."""
    def apart(name: str) -> Column:
        cell = lambda suffix, k: F.shiftrightunsigned(F.col(name + suffix), 8 * k).bitwiseAND(F.lit(255))
        return reduce(operator.add, [F.abs(cell(x, k) - cell(y, k)) for k in range(CELLS)])
    both = lambda name: F.col(name + x) + F.col(name + y)
    rest = F.when(F.col("counted" + x) == F.col("counted" + y), both("own_rest") + apart("cells_rest")).otherwise(
        F.abs(F.col("n_rest" + x) - F.col("n_rest" + y)))
    return both("own") + apart("cells") + rest


def possible(percent: int):
    """pandas UDF: whether two sets may link by size and by the L1 distance of their histograms, which is at
    most the size of their symmetric difference."""
    @F.pandas_udf("boolean")
    def run(n: pd.Series, m: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(n):
            return pd.Series([], dtype=bool)
        x = np.frombuffer(b"".join(a), np.uint16).reshape(len(n), -1).astype(np.int64)
        y = np.frombuffer(b"".join(b), np.uint16).reshape(len(n), -1)
        n, m = n.to_numpy(), m.to_numpy()
        # 100 I >= percent U and U + I = n + m give the largest difference U - I that still links
        most = (n + m) * (100 - percent) / (100 + percent)
        return pd.Series((100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.abs(x - y).sum(1) <= most + 1e-9))
    return run


def verified(pairs: DataFrame, most: int, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` (written, ``most`` at most) whose sets link, on the full sets of the documents that are in a pair."""
    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            common = len(p) + len(q) - len(np.union1d(p, q))
            out.append(100 * common >= percent * (len(p) + len(q) - common))
        return pd.Series(out, dtype=bool)
    own = scratch_table(set_rows(rows_in(texts, pairs, most).dropDuplicates(["id"]), width), "pair_sets")
    both = (pairs.join(own.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
            .join(own.select(F.col("id").alias("b"), F.col("set").alias("y")), "b"))
    return both.filter(linked("x", "y")).select("a", "b")


def components(links: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """id, comp: the least id that each linked id reaches. Each round links every node and its neighbours to
    their least neighbour, larger ones first, then smaller ones (large star, small star), until nothing moves;
    stars are grouped by key with sums on the map side and hold no group in one task's memory."""
    edges = scratch_table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), name)

    def state_of(edges: DataFrame):
        return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    before = state_of(edges)
    # the least neighbours are broadcast while there are few edges
    near = F.broadcast if before["n"] * 100 <= FEW_BYTES else lambda table: table
    for _ in range(most_rounds):
        sym = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(near(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.filter("u > v")
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(near(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        edges = scratch_table(small, name)
        state = state_of(edges)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                       percent: int = 80, orders: int = 3) -> DataFrame:
    """<id_col>, n_shingles, component_id for every row of ``docs``: two documents link when 100 * |intersection| >=
    ``percent`` * |union|, and component_id is the least id that links reach.

    Null and empty texts and texts without words are empty sets and linked with nothing. Ids are expected to
    be unique and not null; repeated rows link with themselves and come once each, a row without an id keeps
    a null component. No rows give no rows; other columns are not read."""
    spark, known = docs.sparkSession, "n > 0 and id is not null"
    with scratch_scope(spark) as keep:
        with scratch_scope(spark) as keep_reps:
            rows = prefixes(docs, id_col, text_col, width, percent, orders)
            sizes = keep(rows.select("id", "n", "digest"), "set_sizes")
            # classes of two rows or more; of each class only the row of its least id goes on
            many = keep(rows.filter(known).groupBy("digest").agg(F.min(F.struct("id", "row")).alias("least"), F.count("*").alias("k")).filter("k > 1")
                        .select("digest", F.col("least.id").alias("rep"), F.col("least.row").alias("rep_row")), "set_classes")
            reps = keep_reps(rows.filter(known).join(few(many), "digest", "left").filter("rep_row is null or row = rep_row")
                             .drop("digest", "rep", "row", "rep_row"), "set_prefixes")
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        joined = keep(class_components(reps, texts, width, percent, orders), "set_components")
    named = sizes.join(few(many).drop("rep_row"), "digest", "left").withColumn("rep", F.coalesce("rep", "id"))
    out = named.join(few(joined).withColumnRenamed("id", "rep"), "rep", "left")
    linked = (F.col("n") > 0) & F.col("id").isNotNull()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(linked, F.coalesce("comp", "rep")).otherwise(F.col("id")).alias("component_id"))


def class_components(reps: DataFrame, texts: DataFrame, width: int, percent: int, orders: int) -> DataFrame:
    """id, comp of the classes that link to another: the three steps."""
    def links_of(pairs: DataFrame, name: str) -> tuple[DataFrame, int]:
        """(the links among ``pairs``, number of pairs)"""
        with scratch_scope(reps.sparkSession) as keep:
            pairs = scratch_table(pairs, f"{name}_pairs")
            n = pairs.count()
            met = scratch_table(filtered(pairs, n, reps, percent, orders), f"{name}_met")
            return keep(verified(met, n, texts, width, percent), f"{name}_links"), n

    # step 1: each class and the pivot of the bucket of its first shared shingle, under each order
    stars = None
    for i in range(orders):
        bucket = reps.filter(F.size(f"p{i}") > 0).select("id", F.element_at(f"p{i}", 1).alias("s"))
        pivot = bucket.groupBy("s").agg(F.min("id").alias("a"), F.count("*").alias("k")).filter("k > 1").drop("k")
        pairs = bucket.join(pivot, "s").filter("id > a").select("a", F.col("id").alias("b"))
        stars = pairs if stars is None else stars.union(pairs)
    first = components(links_of(stars.distinct(), "star")[0], "star_components")

    def joined(first: DataFrame, found: DataFrame, name: str) -> DataFrame:
        return components(first.select(F.col("id").alias("a"), F.col("comp").alias("b")).union(found), name)

    # step 2: components contract, round by round, while rounds link a part of the classes that may still link
    def of_classes(members: DataFrame, name: str) -> DataFrame:
        near = few(members)
        classed = (reps.select("id", "n", *BOUND, *[f"p{i}" for i in range(orders)]).join(near, "id", "left")
                   .withColumn("comp", F.coalesce("comp", "id")))
        return classed if near is not members else scratch_table(classed, name)
    comp, turn = of_classes(first, "class_components"), 0
    while True:
        found, n = links_of(pivot_pairs(comp, orders, percent, turn), f"round_{turn}")
        m = found.count()
        if m:
            first = joined(first, found, f"round_components_{turn}")
            comp = of_classes(first, f"class_components_{turn}")
        if m * ROUND_YIELD < n or not m:
            break
        turn += 1

    # step 3: pairs from different components that meet under every order
    more, _ = links_of(across(comp, orders, percent), "cross")
    return joined(first, more, "class_links") if more.take(1) else first


def pivot_pairs(comp: DataFrame, orders: int, percent: int, turn: int) -> DataFrame:
    """Distinct (a, b), a < b: each class and members of other components, one from each of the ``OFFERS`` smallest buckets
    that it shares with a larger one. A bucket names a member of its largest component by a hash of bucket and round, so a
    class that links to a part of a component meets several of its members. What is left out here comes in ``across``."""
    rows = reduce(DataFrame.union, [comp.filter(100 * F.col("own") <= (100 - percent) * F.col("n")).select(
        "id", "comp", "n", *BOUND, F.lit(i).alias("o"), F.explode(f"p{i}").alias("s")) for i in range(orders)])
    sizes = rows.groupBy("o", "s", "comp").agg(F.count("*").alias("k"), F.min(F.struct(
        F.xxhash64("id", "s", F.lit(turn)).alias("h"), "id", "n", *BOUND)).alias("member"))
    top = (sizes.groupBy("o", "s").agg(F.sum("k").alias("k"), F.max_by(F.struct("comp", "member"), F.struct("k", "comp")).alias("top"), F.count("*").alias("c"))
           .filter("c > 1").select("o", "s", "k", F.col("top.comp").alias("top"), F.col("top.member.id").alias("id2"),
                                   *[F.col(f"top.member.{c}").alias(c + "2") for c in ("n", *BOUND)]))
    met = rows.join(top, ["o", "s"]).filter(
        (F.col("comp") != F.col("top")) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
        & ((100 + percent) * least_difference() <= (100 - percent) * (F.col("n") + F.col("n2"))))
    each = met.groupBy("id", "id2").agg(F.min("k").alias("k"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("k", "id2"))
    return each.withColumn("place", place).filter(F.col("place") <= OFFERS).select(
        F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def across(comp: DataFrame, orders: int, percent: int, most: int = 512) -> DataFrame:
    """Distinct (a, b), a < b, of different components whose prefixes share a shingle. A link shares one under
    every order, so a bucket (shingle) that would give more than ``most`` pairs is left to the next order,
    which looks only at classes from such buckets; the last order takes all that is left. In a bucket the
    largest component meets the others and those meet each other, so a group of copies gives no pairs within, and a
    group whose members differ by shingles of their own gives none that those alone keep apart. A pair
    that shares one of the ``BACK`` shingles before a bucket's in both prefixes is left to that one's bucket; where it
    first meets in either prefix there is none, so it is never left out."""
    names = [f"p{i}" for i in range(orders)]
    # a class with too many shingles of its own links with nothing
    done, now = None, comp.filter(100 * F.col("own") <= (100 - percent) * F.col("n"))
    for i in range(orders):
        rows = now.select("id", "comp", "n", *BOUND, F.inline(F.transform(names[i], lambda s, k: F.struct(
            s.alias("s"), F.slice(names[i], F.greatest(k - (BACK - 1), F.lit(1)), F.least(k, F.lit(BACK))).alias("back")))))
        sizes = rows.groupBy("s", "comp").agg(F.count("*").alias("k"))
        top = (sizes.groupBy("s").agg(F.sum("k").alias("k"), F.max(F.struct("k", "comp")).alias("top"))
               .filter(F.col("k") > F.col("top.k")))
        top = top.select("s", F.col("top.comp").alias("top"), (F.col("k") - F.col("top.k")).alias("rest"), F.col("top.k").alias("own"))
        hot = F.col("own") * F.col("rest") + F.col("rest") * F.col("rest") / 2 > most
        rows = rows.join(top.select("s", "top", hot.alias("hot")), "s")
        ready = rows if i == orders - 1 else rows.filter(~F.col("hot"))
        other = ready.filter(F.col("comp") != F.col("top")).select(
            "s", F.col("id").alias("id2"), F.col("comp").alias("comp2"), F.col("n").alias("n2"),
            *[F.col(c).alias(c + "2") for c in ("back", *BOUND)])
        pairs = ready.join(other, "s").filter(
            ((F.col("comp") == F.col("top")) | (F.col("id") < F.col("id2"))) & (F.col("comp") != F.col("comp2"))
            & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & ~F.arrays_overlap("back", "back2")
            & ((100 + percent) * least_difference() <= (100 - percent) * (F.col("n") + F.col("n2")))).select(
                F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))
        done = pairs if done is None else done.union(pairs)
        if i < orders - 1:
            now = now.join(rows.filter("hot").select("id").distinct(), "id", "left_semi")
    return done.distinct()


def filtered(pairs: DataFrame, most: int, reps: DataFrame, percent: int, orders: int) -> DataFrame:
    """The pairs (written, ``most`` at most) that pass the size and histogram filters and meet under every order."""
    side = lambda d, x, cols: d.select(*[F.col(c).alias(f"{c}_{x}") for c in ("id", *cols)])

    def with_columns(d: DataFrame, rows: DataFrame, cols: list[str]) -> DataFrame:
        return (d.join(side(rows, "a", cols), F.col("a") == F.col("id_a")).drop("id_a")
                .join(side(rows, "b", cols), F.col("b") == F.col("id_b")).drop("id_b"))
    near = with_columns(pairs, rows_in(reps, pairs, most), ["n", "hist"]).filter(possible(percent)("n_a", "n_b", "hist_a", "hist_b"))
    near = scratch_table(near.select("a", "b"), "near_pairs")
    both = with_columns(near, rows_in(reps, near, most), [f"p{i}" for i in range(orders)])
    for i in range(orders):
        both = both.filter(F.arrays_overlap(f"p{i}_a", f"p{i}_b"))
    return both.select("a", "b")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that are not the least id of their component; all columns unchanged. Rows
    without an id stay."""
    with scratch_scope(docs.sparkSession) as keep:
        groups = jaccard_components(docs, id_col=id_col, **options)
        gone = keep(groups.filter(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("gone_id")).distinct(), "near_copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"))
    return rows.join(broadcast_if_small(gone, 50), F.col("id") == F.col("gone_id"), "left_anti").select("row.*")
