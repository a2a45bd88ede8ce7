"""Source divergence audit: how far the word shares of a language's sources lie apart.

Terms are counted once over all texts. The counts of one language and block of terms form a sparse
matrix of groups by terms, indexed term-major. Row by row (Gustavson), a group scatters its terms
through that index into one dense accumulator with a place per peer, so no pair of postings is ever
emitted. Smoothing gives every group a share even of terms it lacks; the accumulator therefore holds
what differs from this zero baseline, which is added once per pair of groups.

With p_g(t) group g's share of term t and z_g its share at count zero, over the V terms of a language:

    sum |p_g - p_h| = V |z_g - z_h| + own(g, h) + own(h, g) + both(g, h)
    own(g, h)  = sum over g's terms of |p_g - z_h| - |z_g - z_h|
    both(g, h) = sum over shared terms of |p_g - p_h| - |p_g - z_h| - |z_g - p_h| + |z_g - z_h|
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from millrace.llm.words import LOWER, Piece, pieces
from millrace.session import scratch_dir

HELD = 400_000          # distinct (language, source, term) rows that a counting task holds
POSTINGS = 1 << 18      # (term, source) entries of a block, about
UNIT = 1_000_000_000    # shares are counted in billionths
LENT = 5                # occurrences lent to every term

# Everything in ASCII but letters ends a term.
GAPS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
COUNTS = "lang string, source string, term string, n long, docs long"
_KEYS = ["lang", "source", "term"]


def terms_of(piece: Piece) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row of each term, its code, the distinct terms), from the bytes themselves."""
    words = piece.words(GAPS)
    ends = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
    body = LOWER[piece.data[words.inside]]
    column = pa.Array.from_buffers(pa.large_string(), len(words.starts),
                                   [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())])
    coded = column.dictionary_encode()
    return words.row(), coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.string())


def counted(piece: Piece) -> pa.Table:
    """(lang, source, term, n, docs) of a piece; a row without a term tells that the group occurs."""
    row, code, terms = terms_of(piece)
    named = [piece.column(c).dictionary_encode() for c in ("lang", "source")]
    lang, source = (x.indices.to_numpy().astype(np.int64) for x in named)
    group = lang * len(named[1].dictionary) + source
    per_doc, n = np.unique(row * max(len(terms), 1) + code, return_counts=True)
    key, place = np.unique(group[per_doc // max(len(terms), 1)] * max(len(terms), 1) + per_doc % max(len(terms), 1),
                           return_inverse=True)
    groups = np.unique(group)
    of = np.concatenate([key // max(len(terms), 1), groups])
    blank = np.zeros(len(groups), dtype=np.int64)
    return pa.table({
        "lang": named[0].dictionary.take(pa.array(of // len(named[1].dictionary))),
        "source": named[1].dictionary.take(pa.array(of % len(named[1].dictionary))),
        "term": terms.take(pa.array(np.concatenate([key % max(len(terms), 1), blank]),
                                    mask=np.arange(len(of)) >= len(key))),
        "n": np.concatenate([np.bincount(place, n, len(key)).astype(np.int64), blank]),
        "docs": np.concatenate([np.bincount(place, minlength=len(key)), blank])})


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), summed within each task and then over tasks."""

    def summed(tables: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(tables).group_by(_KEYS).aggregate([("n", "sum"), ("docs", "sum")])
        return sums.rename_columns([c.removesuffix("_sum") for c in sums.column_names]).select([*_KEYS, "n", "docs"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for piece in pieces(batches):
            held.append(counted(piece))
            if sum(map(len, held)) > 2 * HELD:
                held = [summed(held)]
                if len(held[0]) > HELD:
                    yield from held[0].to_batches(1 << 16)
                    held = []
        if held:
            yield from summed(held).to_batches(1 << 16)

    return docs.mapInArrow(count, COUNTS).groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(UNIT * (n + LENT) / (total + LENT * vocabulary)), without overflow; null for no terms."""
    long = lambda c: c.cast("decimal(19,0)")
    of = F.nullif(long(total) + long(vocabulary.cast("long") * LENT), F.lit(0).cast("decimal(19,0)"))
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * long(n.cast("long") + LENT), of) + 1


def scattered(source: np.ndarray, term: np.ndarray, p: np.ndarray, z: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(g, own(g, h) + both(g, h) for h > g, own(g, h) for h < g) of every group with a term here.

    ``source`` and ``term`` number the postings' groups and terms, ``p`` are their shares; ``z`` has
    the baseline share of every group of the language, so its length is the accumulator's.
    """
    by_term = np.lexsort((source, term))
    peer, peer_p = source[by_term], p[by_term]
    first = np.searchsorted(term[by_term], np.arange(term.max(initial=-1) + 2))
    by_group = np.argsort(source, kind="stable")
    groups, starts = np.unique(source[by_group], return_index=True)
    for g, own in zip(groups, np.split(by_group, starts[1:]), strict=True):
        mine, base = p[own], z[g]
        ranked = np.sort(mine)
        sums = np.concatenate([[0], np.cumsum(ranked)])
        below = np.searchsorted(ranked, z)
        apart = np.abs(base - z)
        # the group's terms against the baseline of every peer
        total = z * below - sums[below] + (sums[-1] - sums[below]) - z * (len(ranked) - below) - len(ranked) * apart
        # its terms through the index: what peers that have them differ by
        n = first[term[own] + 1] - first[term[own]]
        at = np.repeat(first[term[own]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        h, theirs, ours = peer[at], peer_p[at], np.repeat(mine, n)
        later = h > g
        h, theirs, ours = h[later], theirs[later], ours[later]
        differ = np.abs(ours - theirs) - np.abs(ours - z[h]) - np.abs(base - theirs) + apart[h]
        total += np.bincount(h, differ, len(z)).astype(np.int64)     # whole numbers below 2 ** 53
        total[g] = 0
        yield int(g), total


def corrections(postings: DataFrame, peers: DataFrame, blocks: int) -> DataFrame:
    """(lang, a, b, value), a < b: by how much a pair's sum differs from its baseline.

    ``postings`` (lang, source, term, p), ``peers`` (lang, source, z). One task has one block of a
    language's terms, about POSTINGS entries, and one place per source of that language.
    """

    def block_sums(postings: pa.Table, peers: pa.Table) -> pa.Table:
        if not len(postings):
            return pa.table({c: pa.array([], t) for c, t in (
                ("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64()))})
        names = peers["source"].to_numpy()
        order = np.argsort(names)
        names, z = names[order], peers["z"].to_numpy()[order]
        source = np.searchsorted(names, postings["source"].to_numpy())
        term = postings["term"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        out = []
        for g, total in scattered(source, term, postings["p"].to_numpy(), z):
            h = np.flatnonzero(total)
            out.append((np.minimum(g, h), np.maximum(g, h), total[h]))
        a, b, value = (np.concatenate(x) for x in zip(*out, strict=True))
        of = pa.array(names, pa.string())
        return pa.table({"lang": pa.repeat(peers["lang"][0], len(a)), "a": of.take(pa.array(a)),
                         "b": of.take(pa.array(b)), "value": value})

    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    return (postings.select("lang", block, "source", "term", "p").groupBy("lang", "block")
            .cogroup(peers.select("lang", everywhere, "source", "z").groupBy("lang", "block"))
            .applyInArrow(block_sums, "lang string, a string, b string, value long")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          least_docs: int = 30, most_terms: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): every source against its language's other sources and terms.

    Terms are runs of letters and non-ASCII characters, A-Z lower-cased; a language keeps those in at
    least ``least_docs`` of its documents (rows). Part ``pair`` has, for every other source of the
    language, the sum of the shares' differences; part ``term`` the ``most_terms`` terms whose share in
    the source exceeds that in the language most. Ranks go by value descending, then item by code
    point. Null texts, languages and sources are empty strings. A group without a kept term has no
    ``term`` rows; in a language without one all ``pair`` values are 0. A repeated row counts as often as it
    stands. An empty table, or a language's only source, gives no rows. Other columns are ignored.
    """
    spark, folder = docs.sparkSession, scratch_dir(docs.sparkSession, "divergence")
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def kept(table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    counts = kept(count_terms(docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"),
                                          plain(text_col).alias("text"))), "counts")
    frequent = kept(counts.filter("term is not null").groupBy("lang", "term").agg(
        F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs), "frequent")
    found = kept(counts.drop("docs").join(frequent.drop("docs"), ["lang", "term"]), "kept")
    langs = frequent.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    sizes = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = kept(counts.filter("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left")
                  .join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"])
                  .withColumn("z", share(F.lit(0), F.col("total"), F.col("v"))), "groups")
    shares = found.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))
    blocks = max(1, math.ceil(found.count() / POSTINGS))
    fix = corrections(shares, groups.filter("v > 0").select("lang", "source", "z"), blocks)
    peer = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("peer_z"))
    pairs = (groups.join(peer, "lang").filter("source <> item")
             .withColumns({"a": F.least("source", "item"), "b": F.greatest("source", "item")})
             .join(fix, ["lang", "a", "b"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item",
                     (F.coalesce(F.col("v") * F.abs(F.col("z") - F.col("peer_z")), F.lit(0))
                      + F.coalesce("value", F.lit(0))).cast("long").alias("value")))
    terms = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                          (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    return pairs.select("*", rank).unionByName(terms.select("*", rank).filter(F.col("rank") <= most_terms))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return audit(spark.read.parquet(f"{folder}/documents.parquet"))


OP13_SQL = r"""
with d as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents),
w as (
  select doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as c from w group by lang, term having count(distinct doc) >= 30),
vocabulary as (select lang, count(*) as v, sum(c) as n from kept group by lang),
counts as (
  select w.lang, w.source, w.term, count(*) as c from w join kept using (lang, term) group by all),
sizes as (
  select g.lang, g.source, coalesce(sum(c.c), 0) as n
  from (select distinct lang, source from d) g left join counts c on g.lang = c.lang and g.source = c.source
  group by all),
shares as (
  select s.lang, s.source, k.term, coalesce(c.c, 0) as c,
         1 + (1000000000::hugeint * (coalesce(c.c, 0) + 5)) // (s.n + 5 * v.v) as p,
         1 + (1000000000::hugeint * (k.c + 5)) // (v.n + 5 * v.v) as q
  from sizes s join vocabulary v on v.lang = s.lang join kept k on k.lang = s.lang
  left join counts c on c.lang = s.lang and c.source = s.source and c.term = k.term),
sums as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
parts as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from sizes a join sizes b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all
  select lang, source, 'term', term, p - q from shares where c > 0 and p > q),
ranked as (
  select lang, source, part, item, value::bigint as value,
         row_number() over (partition by lang, source, part order by value desc, item)::int as rank
  from parts)
select * from ranked where part = 'pair' or rank <= 50
"""
