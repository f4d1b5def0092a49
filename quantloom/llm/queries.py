"""Queries of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clusters, embeddings, licenses, linededup, media, minhash, mixing, phrases, quality, repeats, sharding, tokenout
from .common import read_table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; see bpe.DIGESTS."""
    return bpe.round_trip(read_table(spark, sf_dir, "documents"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines aligned with an earlier one: doc_id, n_lines, n_removed, kept_sha256."""
    docs = read_table(spark, sf_dir, "documents")
    out, gone = linededup.lines_removed(docs), linededup.gone_name(docs)
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    kept = F.coalesce(linededup.kept_text(gone), F.lit(""))
    return out.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated 400-byte strings: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and
    whether the document shares a passage of words with another."""
    out = repeats.without_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "in_passage")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies: doc_id, n_shingles, component_id, kept."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents: a row for each use, with source, epoch, position in it, and tokens."""
    return mixing.permuted(read_table(spark, sf_dir, "documents"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as ORC and indexed from the files: doc_id, start, n_tokens, ids_crc32."""
    return tokenout.tokens_round_trip(read_table(spark, sf_dir, "documents"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards of near equal bytes."""
    return sharding.sharded(read_table(spark, sf_dir, "documents"), 8)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as PNG and read back; see media.DECODED."""
    return media.media_features(media.stored(read_table(spark, sf_dir, "documents")))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component: vec_id, n_links, component_id, kept."""
    return embeddings.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score: doc_id, held_out, score, predicted."""
    docs = read_table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector's cluster: vec_id, cluster, distance, inertias and the centroid's digest."""
    return clusters.clustered(read_table(spark, sf_dir, "embeddings"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence phrases and templates: doc_id, counts, places, labels and score."""
    return licenses.license_scan(read_table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best collocations: lang, rank, phrase, a, l, r, n, score."""
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_lines": op2_lines,
        "op3_repeats": op3_repeats,
        "op4_minhash": op4_minhash,
        "op5_mixing": op5_mixing,
        "op6_tokens": op6_tokens,
        "op7_shards": op7_shards,
        "op8_media": op8_media,
        "op9_vectors": op9_vectors,
        "op10_quality": op10_quality,
        "op11_centroids": op11_centroids,
        "op12_licenses": op12_licenses,
        "op13_phrases": op13_phrases,
    }


_REACH = """reach as (select id, id as to_ from nodes union select reach.id, link.b from reach join link on link.a = reach.to_),
top as (select id, min(to_) as component from reach group by 1), deg as (select a as id, count(*) as n from link group by 1)"""

def _rounds(n: int) -> str:
    """Assignments a0, a1, ... and centroids c1, c2, ... of the rounds, one after the other."""
    nearest = """a{i} as materialized (select row, k, s from (select *, row_number() over (partition by row order by s, k) as p
from (select row, k, sum((x - c) * (x - c)) as s from e join c{i} using (i) group by 1, 2)) where p = 1)"""
    moved = """c{j} as materialized (select k, i, coalesce(m, c) as c from c{i} left join
(select k, i, (s // n - case when s % n < 0 then 1 else 0 end)::bigint as m from (select k, i, sum(x) as s, count(*) as n from a{i} join e using (row) group by 1, 2)) using (k, i))"""
    return ",\n".join(x for i in range(n) for x in (nearest.format(i=i), moved.format(i=i, j=i + 1))) + ",\n" + nearest.format(i=n)


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BASE = " union all ".join(
    f"select row, i, '{label}' as label from w, unnest(range(len(l))) as u(i) where " + " and ".join(f"l[i + {k + 1}] = '{p}'" for k, p in enumerate(phrase.split(" "))) for phrase, label in licenses.PHRASES.items()
)
_TEMPLATES = ", ".join(f"('{label}', {sorted(words)}, {need})" for label, words, need in licenses._templates(licenses.TEMPLATES, licenses.PERCENT))

ORACLES = {
    "op11_centroids": f"""with kept as materialized (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
e as materialized (select row, unnest(v) as x, generate_subscripts(v, 1) as i from kept),
starts as (select v, row_number() over (order by sha256('3:' || vec_id), v) - 1 as k from kept where vec_id is not null qualify k < 8), c0 as (select k, unnest(v) as c, generate_subscripts(v, 1) as i from starts),
{_rounds(clusters.ROUNDS)},
d as (select k, sha256(string_agg(c::varchar, ',' order by i)) as h from c{clusters.ROUNDS} group by 1), t as (select k, sum(s) as s from a{clusters.ROUNDS} group by 1)
select vec_id, k::int as cluster, a.s::bigint as distance, t.s::bigint as cluster_inertia, (select sum(s) from t)::bigint as inertia, h as centroid_sha256 from a{clusters.ROUNDS} a join kept using (row) join d using (k) join t using (k)""",
    "op12_licenses": rf"""with docs as materialized (select row_number() over () as row, doc_id, {_LOW} as low from documents), w as (select row, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as l from docs),
lines as (select row, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as l from (select row, unnest(string_split(low, chr(10))) as x from docs)),
blocks as (select row, l[s + 1 : s + {licenses.BLOCK}] as b from lines, unnest(range(0, greatest(1, len(l) - {licenses.BLOCK // 2}), {licenses.BLOCK // 2})) as u(s)),
t(label, words, need) as (values {_TEMPLATES}),
found as (select row, list(distinct label) as more, max(k / size) as part from (select row, label, len(list_intersect(b, words)) as k, len(words)::double as size, need from blocks join t on len(b) >= need) where k >= need group by 1),
base as ({_BASE}), places as (select row, count(*) as n, min(i) as a, max(i) as b, list(distinct label) as labels from base group by 1)
select doc_id, len(l)::bigint as n_words, coalesce(p.n, 0) as n_base, p.a as first_word, p.b as last_word, array_to_string(list_sort(coalesce(labels, [])), ',') as base_labels,
array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(more, [])))), ',') as labels, case when p.n > 0 then 1.0::double else coalesce(part, 0)::double end as score
from docs join w using (row) left join places p using (row) left join found using (row)""",
    "op13_phrases": rf"""with p as (select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from documents),
u as (select lang, unnest(w) as x from p), f1 as materialized (select lang, [x] as g, count(*) as n from u group by 1, 2), total as (select lang, sum(n)::bigint as n from f1 group by 1),
f2 as materialized (select lang, w[i : i + 1] as g, count(*) as n from p, unnest(range(1, len(w))) as u(i) group by 1, 2), f3 as materialized (select lang, w[i : i + 2] as g, count(*) as n from p, unnest(range(1, len(w) - 1)) as u(i) group by 1, 2 having count(*) >= 10),
c as (select f.lang, f.g, f.n as a, x.n as l, y.n as r, 1 as k from f2 f join f1 x on x.lang = f.lang and x.g = f.g[1:1] join f1 y on y.lang = f.lang and y.g = f.g[2:2] where f.n >= 10
union all select f.lang, f.g, f.n, x.n, y.n, 1 from f3 f join f1 x on x.lang = f.lang and x.g = f.g[1:1] join f2 y on y.lang = f.lang and y.g = f.g[2:3]
union all select f.lang, f.g, f.n, x.n, y.n, 2 from f3 f join f2 x on x.lang = f.lang and x.g = f.g[1:2] join f1 y on y.lang = f.lang and y.g = f.g[3:3]),
s as (select *, 1000000::hugeint * a * a // (l::hugeint * r) as score from c), best as (select * from s qualify row_number() over (partition by lang, g order by score, k) = 1),
cover as (select lang, g, max(n) as longer from (select lang, g[1:2] as g, n from f3 union all select lang, g[2:3], n from f3) group by 1, 2),
ok as (select b.*, array_to_string(b.g, ' ') as phrase from best b left join cover using (lang, g) where len(b.g) = 3 or longer is null or 100 * longer < 50 * a)
select lang, rank, phrase, a, l, r, total.n as n, score::bigint as score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from ok) join total using (lang) where rank <= 2000""",

    "op4_minhash": rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as l from documents),
s as (select distinct doc_id, sh from (select doc_id, unnest(case when len(l) >= 5 then list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i : i + 4], ' ')) when len(l) > 0 then [array_to_string(l, ' ')] else [] end) as sh from w)),
n as (select doc_id, count(*) as n from s group by 1), met as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.sh = y.sh and x.doc_id <> y.doc_id group by 1, 2),
link as (select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)), nodes as (select doc_id as id from documents), {_REACH}
select d.doc_id, coalesce(n.n, 0) as n_shingles, component as component_id, d.doc_id = component as kept from documents d join top on top.id = d.doc_id left join n on n.doc_id = d.doc_id""",
    "op9_vectors": f"""with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
ok as (select * from v where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
link as (select x.vec_id as a, y.vec_id as b from ok x join ok y on x.label = y.label and x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.98), nodes as (select vec_id as id from embeddings), {_REACH}
select vec_id, coalesce(n, 0) as n_links, component as component_id, vec_id = component as kept from embeddings join top on top.id = vec_id left join deg on deg.id = vec_id""",
}


def oracle_sql() -> dict[str, str]:
    """Where SQL says the whole result at a bearable cost: links of sets and vectors by all pairs, clusters round by
    round, all blocks against all templates, all phrases."""
    return dict(ORACLES)
