"""Term statistics in long form: one row per (document, term), never a dense matrix."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contrasieve.functions import text as tx
from contrasieve.operators.sampling import top_per_group
from contrasieve.session import cut_lineage

#: Documents whose n-grams a task counts at a time.
TFIDF_ROWS = 512
#: Pairs of group and n-gram that are counted in an array; more are sorted.
COUNTED_CELLS = 4_000_000
#: Slots of a sketch that travel as one row.
SKETCH_PART = 1 << 16


def term_table(df: DataFrame, key: str, tokens: Column, n_min: int = 1, n_max: int = 1, carry: Sequence[str] = ()) -> DataFrame:
    """(key, *carry, term) rows, one per occurrence of an n-gram."""
    arrays = df.select(key, *carry, tokens.alias("_tokens"))
    grams = F.col("_tokens") if (n_min, n_max) == (1, 1) else tx.ngrams(F.col("_tokens"), n_min, n_max)
    return arrays.select(key, *carry, F.explode(grams).alias("term"))


def presence_table(df: DataFrame, key: str, tokens: Column, n_min: int = 1, n_max: int = 1, carry: Sequence[str] = ()) -> DataFrame:
    """(key, *carry, term) rows, one per distinct n-gram of a document; made without a shuffle."""
    arrays = df.select(key, *carry, tokens.alias("_tokens"))
    grams = F.col("_tokens") if (n_min, n_max) == (1, 1) else tx.ngrams(F.col("_tokens"), n_min, n_max)
    return arrays.select(key, *carry, grams.alias("_grams")).select(
        key, *carry, F.explode(F.array_distinct("_grams")).alias("term")
    )


def _slots(words: pa.Array, n: int, bits: int) -> np.ndarray:
    """A slot of 2^bits for each n-gram of ``words``, the same in every task."""
    coded = words.dictionary_encode()
    hashed = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)[coded.indices.to_numpy(zero_copy_only=False)]
    out = hashed[: len(words) - n + 1].copy()
    for i in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashed[i : len(words) - n + 1 + i]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (out >> np.uint64(64 - bits)).astype(np.int64)


def _bitmap(terms: DataFrame, n: int, bits: int) -> np.ndarray:
    """One bit per slot that an n-gram of the table has: 2^bits / 8 bytes, whatever the table's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                slot = _slots(pa.compute.split_pattern(batch["term"], " ").flatten(), n, bits)[::n]
                yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(np.int64(1) << (slot & 63))], ["at", "bits"])

    words = terms.select("term").mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(max(1 << bits >> 6, 1), np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def _reached(counted: DataFrame, bits: int, least: int) -> np.ndarray:
    """One bit per slot whose counts, summed over the rows (part, counts), reach ``least``: 2^``bits`` / 8 bytes."""

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(1, np.int64)
        for chunk in table["counts"].chunks:
            for counts in chunk:
                total = total + np.frombuffer(counts.as_buffer(), _counter(least))
        return pa.table({"part": table["part"].slice(0, 1), "bits": pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())})

    found = counted.groupBy("part").applyInArrow(merge, "part int, bits binary").toArrow()
    slots = min(1 << bits, SKETCH_PART)
    out = np.zeros((max(1, (1 << bits) // slots), -(-slots // 8)), np.uint8)
    for part, marks in zip(found["part"].to_pylist(), found["bits"].to_pylist()):
        out[part] = np.frombuffer(marks, np.uint8)
    return out.ravel()


def _counter(least: int) -> np.dtype:
    return np.min_scalar_type(max(1, least))


def _has(marked: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (marked[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def grown_ngrams(
    df: DataFrame, key: str, tokens: Column, counts: Mapping[str, Column], n_max: int = 4, min_docs: int = 5, carry: Sequence[str] = (), bits: int = 24
) -> DataFrame:
    """(term, n_words, n_docs, *counts) of every n-gram that ``min_docs`` documents or more contain.

    Level by level: a longer n-gram is counted only where both (n-1)-grams in it reached the minimum, so nearly all long
    ones never leave their task. Those are marked in a bitmap of 2^``bits`` slots, whose size is fixed; a slot that two terms share only
    lets more candidates through, and counts stay exact. Before n-grams travel as strings, each task adds up the documents per slot of
    2^(``bits`` + 2), and only n-grams of slots that reach ``min_docs`` over all tasks leave theirs. ``counts`` are aggregates over a term's documents, which hold the
    key and ``carry``. Tokens hold no spaces. Null token arrays, null tokens and empty tables give no terms. One row of
    ``df`` is one document, whatever its key.
    """
    words_of = F.coalesce(F.filter(tokens, lambda w: w.isNotNull()), F.array().cast("array<string>"))
    arrays = cut_lineage(df.select(key, *carry, words_of.alias("_tokens")), compression="zstd")
    kept = [key, *carry]
    kinds = ", ".join(f"`{c}` {dict(arrays.dtypes)[c]}" for c in kept)
    levels, before, wide = [], None, bits + 2
    for n in range(1, n_max + 1):

        def candidates(batches: Iterator[pa.RecordBatch], n: int = n, before: np.ndarray | None = before) -> Iterator[tuple]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    lists = batch["_tokens"]
                    words = lists.flatten()
                    if len(words) < n:
                        continue
                    size = lists.value_lengths().to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(len(size)), size)
                    starts = np.flatnonzero(row[: len(words) - n + 1] == row[n - 1 :])
                    known = _has(before, _slots(words, n - 1, bits))
                    starts = starts[known[starts] & known[starts + 1]]
                    yield batch, words, row, starts, _slots(words, n, wide)[starts]

        def sketch(batches: Iterator[pa.RecordBatch], candidates=candidates) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(1 << wide, _counter(min_docs))
            for _, _, row, starts, slot in candidates(batches):
                once = np.unique((row[starts] << wide) + slot) & ((1 << wide) - 1)
                met, docs = np.unique(once, return_counts=True)
                seen[met] = np.minimum(seen[met].astype(np.int64) + docs, min_docs)
            for part, counts in enumerate(seen.reshape(-1, min(1 << wide, SKETCH_PART))):
                if counts.any():
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["part", "counts"])

        if n == 1:
            rows = presence_table(arrays, key, F.col("_tokens"), carry=carry)
        else:
            enough = _reached(arrays.mapInArrow(sketch, "part int, counts binary"), wide, min_docs)

            def run(batches: Iterator[pa.RecordBatch], n: int = n, candidates=candidates, enough: np.ndarray = enough) -> Iterator[pa.RecordBatch]:
                for batch, words, row, starts, slot in candidates(batches):
                    starts = starts[_has(enough, slot)]
                    parts = [words.take(pa.array(starts + i)) for i in range(n)]
                    term = pa.compute.binary_join_element_wise(*parts, " ")
                    pairs = pd.DataFrame({"row": row[starts], "term": term.dictionary_encode().indices.to_numpy(zero_copy_only=False)})
                    once = np.flatnonzero(~pairs.duplicated().to_numpy())
                    of = pa.array(row[starts][once])
                    yield pa.RecordBatch.from_arrays([*(batch[c].take(of) for c in kept), term.take(pa.array(once))], [*kept, "term"])

            rows = arrays.mapInArrow(run, f"{kinds}, term string")
        counted = rows.groupBy("term").agg(F.count("*").alias("n_docs"), *(c.alias(name) for name, c in counts.items()))
        levels.append(cut_lineage(counted.where(F.col("n_docs") >= min_docs).withColumn("n_words", F.lit(n))))
        if n < n_max:
            before = _bitmap(levels[-1], n, bits)
            if not before.any():
                break
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("term", "n_words", "n_docs", *counts)


def document_frequency(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    return presence_table(df, key, tokens).groupBy("term").agg(F.count("*").alias("n_docs"))


def frequencies(terms: DataFrame, keys: Sequence[str], top: int) -> DataFrame:
    """The most frequent terms, overall or per key, ties by term."""
    counts = terms.groupBy(*keys, "term").agg(F.count("*").alias("n"))
    if not keys:
        return counts.orderBy(F.desc("n"), "term").limit(top)
    return top_per_group(counts, keys, [F.desc("n"), F.col("term")], top, "term")


def zipf(terms: DataFrame, keys: Sequence[str], top: int = 200) -> DataFrame:
    """Rank-frequency curve of the top terms and its log-log slope."""
    best = frequencies(terms, keys, top)
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))  # at most ``top`` rows per key
    curve = best.withColumn("rnk", F.row_number().over(group.orderBy(F.desc("n"), "term")))
    slope = F.regr_slope(F.log("n"), F.log(F.col("rnk").cast("double"))).over(group)
    return curve.withColumn("slope", slope)


def _gram_counts(lists: pa.ListArray, n_max: int, marked: np.ndarray | None = None, bits: int = 24, group: np.ndarray | None = None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per n: (words, codes, row, gram, tf) with one entry per distinct n-gram of a row of token lists.

    ``words`` are the distinct words; row i of ``codes`` has the places in it that make n-gram i. N-grams stay inside one token list. Longer
    ones with a word that the bitmap ``marked`` lacks are left out. With ``group`` rows of one group count together.
    """
    inner = lists.flatten()
    coded = inner.flatten().dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    per_list, per_row = (x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in (inner, lists))
    of_list = np.repeat(np.arange(len(per_list)), per_list)
    of_row = np.repeat(np.arange(len(per_row)), per_row)[of_list]
    of_row = of_row if group is None else group[of_row]
    gram, codes = code, np.arange(len(words))[:, None]
    slot = _slots(words, 1, bits) if marked is not None else None
    known = np.ones(len(words), bool) if marked is None else (marked[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
    for n in range(1, n_max + 1):
        if n > 1:
            starts = np.flatnonzero(of_list[: len(code) - n + 1] == of_list[n - 1 :]) if len(code) >= n else np.zeros(0, np.int64)
            starts = starts[known[code[starts + n - 1]] & (gram[starts] >= 0) & (n > 2 or known[code[starts]])]
            pairs = np.full(len(code), -1, np.int64)
            pairs[starts] = gram[starts] * len(words) + code[starts + n - 1]
            found, at = np.unique(pairs[starts], return_inverse=True)
            codes = np.column_stack([codes[found // max(1, len(words))], found % max(1, len(words))])
            gram = np.full(len(code), -1, np.int64)
            gram[starts] = at
        here = np.flatnonzero(gram >= 0)
        both = of_row[here] * max(1, len(codes)) + gram[here]
        if len(both) and both.max() < COUNTED_CELLS:
            tf = np.bincount(both)
            both = np.flatnonzero(tf)
            tf = tf[both]
        else:
            both, tf = np.unique(both, return_counts=True)
        yield words, codes, both // max(1, len(codes)), both % max(1, len(codes)), tf


def _named(words: pa.Array, codes: np.ndarray) -> pa.Array:
    parts = [words.take(pa.array(codes[:, j])) for j in range(codes.shape[1])]
    return pa.compute.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]


def gram_counts(lists: DataFrame, n: int, keys: Sequence[str], marked: np.ndarray | None = None) -> DataFrame:
    """(*keys, term, n): n-grams of the token lists ``_lists`` with their number per key; those of ``marked`` words only, if given."""
    kinds = dict(lists.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TFIDF_ROWS):
                batch = whole.slice(at, TFIDF_ROWS)
                group = batch.select(keys).to_pandas().groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy()
                first = np.unique(group, return_index=True)[1]
                *_, (words, codes, own, gram, total) = _gram_counts(batch["_lists"], n, marked, group=group)
                cells = [*(batch[k].take(pa.array(first[own])) for k in keys), _named(words, codes[gram]), pa.array(total)]
                yield pa.RecordBatch.from_arrays(cells, [*keys, "term", "n"])

    counted = lists.mapInArrow(run, "".join(f"`{k}` {kinds[k]}, " for k in keys) + "term string, n bigint")
    return counted.groupBy(*keys, "term").agg(F.sum("n").alias("n"))


def top_words_and_pairs(df: DataFrame, tokens: Column, keys: Sequence[str], top: int, lead: int = 64) -> DataFrame:
    """(*keys, n_words, term, n): the most frequent words and pairs of neighbours per key, ties by term.

    A pair is no more frequent than its words. Pairs of the ``lead`` most frequent words are counted first: the last of
    their best ``top`` is a floor that every pair of the answer reaches. Then only pairs whose words both reach the floor of some key
    are counted; words are marked in a bitmap of fixed size, and counts stay exact. Tokens hold no spaces.
    """
    words = F.coalesce(F.filter(tokens, lambda w: w.isNotNull()), F.array().cast("array<string>"))
    lists = cut_lineage(df.select(*keys, F.array(words).alias("_lists")))
    singles = cut_lineage(gram_counts(lists, 1, keys))

    def best(counts: DataFrame, n: int) -> DataFrame:
        return top_per_group(counts, keys, [F.desc("n"), F.col("term")], n, "term")

    leaders = best(singles, lead).select("term").distinct()
    floor = best(gram_counts(lists, 2, keys, _bitmap(leaders, 1, 24)), top).groupBy(*keys).agg(F.when(F.count("*") >= top, F.min("n")).alias("floor"))
    able = singles.join(F.broadcast(floor), list(keys), "left").filter(F.col("n") >= F.coalesce("floor", F.lit(0)))
    pairs = gram_counts(lists, 2, keys, _bitmap(able.select("term").distinct(), 1, 24))
    columns = [*keys, "n_words", "term", "n"]
    return best(singles, top).withColumn("n_words", F.lit(1)).select(columns).unionByName(best(pairs, top).withColumn("n_words", F.lit(2)).select(columns))


def _merged(df: DataFrame, key: str, tokens: Column, carry: Sequence[str]) -> DataFrame:
    """(key, _lists, _rows): the token lists of all rows of a key and what each of these rows carries.

    Rows are brought together only if a key repeats; a table without such keys is not shuffled.
    """
    words = F.coalesce(F.filter(tokens, lambda w: w.isNotNull()), F.array().cast("array<string>"))
    shown = F.struct(F.lit(1).alias("_one"), *[F.when(F.col(key).isNotNull(), F.col(c)).alias(c) for c in carry])
    rows = df.select(key, F.array(words).alias("_lists"), F.array(shown).alias("_rows"))
    if not df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").isEmpty():
        rows = rows.groupBy(key).agg(F.flatten(F.collect_list("_lists")).alias("_lists"), F.flatten(F.collect_list("_rows")).alias("_rows"))
        once = F.col(key).isNull() if carry else F.lit(True)
        rows = rows.withColumn("_rows", F.when(once, F.slice("_rows", 1, 1)).otherwise(F.col("_rows")))
    return cut_lineage(rows)


def tfidf(
    df: DataFrame,
    key: str,
    tokens: Column,
    n_max: int = 2,
    min_df: int = 10,
    max_df: float = 1.0,
    max_terms: int = 30_000,
    sublinear: bool = True,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(key, *carry, term, weight): smooth idf, sub-linear tf, unit rows.

    The vocabulary keeps the most frequent terms of the corpus; it is bounded by
    ``max_terms``, which is what makes broadcasting it safe. Rows of one key are one document. Tasks count terms
    per document, so only sums per term are shuffled. With ``carry`` each row of ``df`` gets the weights of its
    document, and null keys get one set of weights with nulls. Tokens hold no spaces.
    """
    n_docs = df.agg(F.count("*")).scalar()
    docs = _merged(df, key, tokens, carry)
    kinds = dict(docs.dtypes) | {c: dict(df.dtypes)[c] for c in carry}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TFIDF_ROWS):
                for words, codes, _, gram, tf in _gram_counts(whole["_lists"].slice(at, TFIDF_ROWS), n_max):
                    df_total = np.bincount(gram, minlength=len(codes)), np.bincount(gram, tf, len(codes)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([_named(words, codes), *map(pa.array, df_total)], ["term", "df", "total"])

    vocabulary = (
        docs.select("_lists")
        .mapInArrow(counted, "term string, df bigint, total bigint")
        .groupBy("term")
        .agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
        .filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_docs))
        .orderBy(F.desc("total"), "term")
        .limit(max_terms)
        .select("term", (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))
        .toArrow()
    )
    shared = df.sparkSession.sparkContext.broadcast((vocabulary["term"].combine_chunks(), vocabulary["idf"].to_numpy()))
    kept = [key, *carry]

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, TFIDF_ROWS):
                batch = whole.slice(at, TFIDF_ROWS)
                parts = []
                for words, codes, row, gram, tf in _gram_counts(batch["_lists"], n_max):
                    place = pa.compute.index_in(_named(words, codes), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)[gram]
                    known = place >= 0
                    parts.append((row[known], place[known], tf[known]))
                row, place, tf = (np.concatenate(x) for x in zip(*parts))
                w = (1 + np.log(tf) if sublinear else tf) * idf[place]
                norm = np.sqrt(np.bincount(row, w * w, batch.num_rows))
                of = pa.array(row)
                cells = [*(batch[c].take(of) for c in kept), terms.take(pa.array(place)), pa.array(w / norm[row])]
                yield pa.RecordBatch.from_arrays(cells, [*kept, "term", "weight"])

    rows = docs.select(key, "_lists", F.explode("_rows").alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in carry], "_lists")
    return rows.mapInArrow(weighted, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", term string, weight double")


def _labelled(weights: DataFrame, labels: DataFrame, key: str, label: str, how: str = "inner") -> DataFrame:
    """Weights with the label of each row of their key; those that carry it already are not joined again."""
    if label in weights.columns:
        return weights.filter(F.col(key).isNotNull()) if how == "inner" else weights
    return weights.join(labels.select(key, label), key, how)


def chi_square(weights: DataFrame, labels: DataFrame, key: str, label: str, top: int = 10_000) -> DataFrame:
    """χ² of non-negative term weights against the class, highest first."""
    share = labels.groupBy(label).agg(F.count("*").alias("_n")).withColumn(
        "_p", F.col("_n") / labels.agg(F.count("*")).scalar()
    )
    sums = cut_lineage(_labelled(weights, labels, key, label).groupBy("term", label).agg(F.sum("weight").alias("o")))
    totals = sums.groupBy("term").agg(F.sum("o").alias("t"))
    # Classes a term never meets have o = 0 and add their whole expectation, t * p.
    joined = sums.join(totals, "term").join(share.select(label, "_p"), label)
    e = F.col("t") * F.col("_p")
    scored = joined.groupBy("term").agg(
        F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("met"),
        (F.max("t") * (1 - F.sum("_p"))).alias("unmet"),
    )
    return scored.select("term", (F.col("met") + F.col("unmet")).alias("chi2")).orderBy(F.desc("chi2"), "term").limit(top)


def class_presence(presence: DataFrame, positive: Column) -> DataFrame:
    """Documents with the term in the positive and in the other class."""
    return presence.groupBy("term").agg(F.count_if(positive).alias("n_pos"), F.count_if(~positive).alias("n_neg"))


def class_sizes(df: DataFrame, positive: Column) -> tuple[Column, Column]:
    """Scalar sizes of the two classes, to be used inside other expressions."""
    return df.agg(F.count_if(positive)).scalar(), df.agg(F.count_if(~positive)).scalar()


def mutual_information(counts: DataFrame, n_pos: Column, n_neg: Column, top: int = 30) -> DataFrame:
    """Mutual information (nats) of term presence and class."""
    n = (n_pos + n_neg).cast("double")
    has = F.col("n_pos") + F.col("n_neg")

    def part(joint: Column, a: Column, b: Column) -> Column:
        return F.when(joint > 0, joint / n * F.log(n * joint / (a * b))).otherwise(0.0)

    mi = (
        part(F.col("n_pos"), has, n_pos)
        + part(F.col("n_neg"), has, n_neg)
        + part(n_pos - F.col("n_pos"), n - has, n_pos)
        + part(n_neg - F.col("n_neg"), n - has, n_neg)
    )
    return counts.select("term", mi.alias("mi")).orderBy(F.desc(F.round("mi", 9)), "term").limit(top)


def log_odds(counts: DataFrame, n_pos: Column, n_neg: Column, min_share: float = 0.005) -> DataFrame:
    """Keyword discovery: smoothed log odds of presence, weighted by support."""
    support = F.col("n_pos") + F.col("n_neg")
    least = F.greatest(F.lit(3), F.floor(F.lit(min_share) * (n_pos + n_neg)))
    ratio = F.log(((F.col("n_pos") + 1) / (n_pos + 1)) / ((F.col("n_neg") + 1) / (n_neg + 1)))
    kept = counts.filter(support >= least).withColumn("log_odds", ratio)
    return kept.withColumn("score", F.col("log_odds") * F.log1p(support.cast("double")))


def domain_terms(counts: DataFrame, n_pos: Column, n_neg: Column, min_freq: int = 5) -> DataFrame:
    """n-gram terms of the positive class: Laplace log odds with a bonus for longer terms."""
    words = F.size(F.split("term", " "))
    ratio = F.log(((F.col("n_pos") + 1) / (n_pos + 2)) / ((F.col("n_neg") + 1) / (n_neg + 2)))
    kept = counts.filter(F.col("n_pos") + F.col("n_neg") >= min_freq)
    scored = kept.withColumn("n_words", words).withColumn("log_odds", ratio)
    scored = scored.withColumn("score", F.col("log_odds") * (1 + (F.col("n_words") - 1) * 0.3))
    return scored.filter("score > 0")


def class_share_ratio(weights: DataFrame, labels: DataFrame, key: str, label: str, a: str, b: str) -> DataFrame:
    """Log ratio of a term's share of TF-IDF mass in two classes, smoothed by one half."""
    sums = cut_lineage(_labelled(weights, labels.filter(F.col(label).isin(a, b)), key, label, "left").groupBy("term").agg(
        F.sum(F.when(F.col(label) == a, F.col("weight")).otherwise(0.0)).alias("sa"),
        F.sum(F.when(F.col(label) == b, F.col("weight")).otherwise(0.0)).alias("sb"),
    ))
    mass = sums.agg(F.struct(F.sum("sa").alias("a"), F.sum("sb").alias("b"), F.count("*").alias("n"))).scalar()
    share = lambda c, m: (F.col(c) + 0.5) / (m + 0.5 * mass["n"])
    return sums.select("term", F.log(share("sa", mass["a"]) / share("sb", mass["b"])).alias("log_ratio"))


def top_terms(weights: DataFrame, groups: DataFrame, key: str, group: str, k: int = 8) -> DataFrame:
    """Terms with the largest TF-IDF mass in each class or cluster."""
    sums = _labelled(weights, groups, key, group).groupBy(group, "term").agg(F.sum("weight").alias("mass"))
    return top_per_group(sums, [group], [F.desc(F.round("mass", 9)), F.col("term")], k, "term")


def keyword_table(presence: DataFrame, keywords: Sequence[str], positive: Column, n_pos: Column, n_neg: Column) -> DataFrame:
    """Presence of each keyword in both classes, percent and lift."""
    counts = class_presence(presence.filter(F.col("term").isin(list(keywords))), positive)
    pct_pos, pct_neg = 100 * F.col("n_pos") / n_pos, 100 * F.col("n_neg") / n_neg
    lift = F.when(F.col("n_neg") > 0, pct_pos / pct_neg)
    return counts.select("term", "n_pos", "n_neg", pct_pos.alias("pct_pos"), pct_neg.alias("pct_neg"), lift.alias("lift"))


def duplicate_texts(df: DataFrame, key: str, text: Column, agency: str) -> DataFrame:
    """Groups of rows with the same text key: size, distinct agencies, first id."""
    keyed = df.select(key, agency, F.md5(tx.text_key(text)).alias("text_key"))
    out = keyed.groupBy("text_key").agg(
        F.count("*").alias("n_rows"), F.countDistinct(agency).alias("n_agencies"), F.min(key).alias("first_id")
    )
    return out.filter("n_rows > 1")
