"""Registered queries of the corpus operators, each over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from flowloom.llm import bpe, bytecnn, mixing, nndescent, pii, qda, quality, runs, simhash, topk, toxicity, warc, whitening
from flowloom.llm.common import SPACES, crc_part, new_folder, table

#: Folder of tokenizer files; the installed package knows its own.
TOKENIZERS = os.environ.get("FLOWLOOM_TOKENIZERS")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark, sf_dir):
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op2_bpe(spark, sf_dir):
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    docs, held = table(spark, sf_dir, "documents"), crc_part(3, 1)
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held), "toxic")
    return toxicity.score(docs, lexicon, held)


def op6_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_warc(spark, sf_dir):
    path = new_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.resolved_records(warc.read_archives(spark, path, payloads=False))


def op8_nn_descent(spark, sf_dir):
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_quality_qda(spark, sf_dir):
    held = crc_part(4, 2)
    return qda.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held), "quality", held)


def op10_language(spark, sf_dir):
    docs, held = table(spark, sf_dir, "documents"), crc_part(4, 2)
    return bytecnn.predict(docs, bytecnn.fit(docs.where(~held & F.col("lang").isNotNull())), held)


def op11_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_runs(spark, sf_dir):
    return runs.digests(runs.find(runs.planted(table(spark, sf_dir, "documents"), SPACES)))


def op13_topk(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).withColumnRenamed("id", "vec_id")


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_bpe, op3_simhash, op4_pii, op5_toxicity, op6_mixing, op7_warc, op8_nn_descent, op9_quality_qda, op10_language,
    op11_whitening, op12_runs, op13_topk)}

_SPACE = r"[ \t-\r]"
ORACLES = {
    "op1_quality_rules": rf"""with d as (select doc_id, source, coalesce(text, '') as t from documents),
  w as (select doc_id, t, [x for x in string_split_regex(t, '{_SPACE}+') if x <> ''] as ws from d),
  windows as (select doc_id, i, list_slice(ws, i, i + 7) as g from w, unnest(range(1, len(ws) - 6)) u(i)),
  repeated as (select doc_id, i from windows qualify count(*) over (partition by doc_id, g) > 1),
  covered as (select doc_id, count(distinct i + k) as n from repeated, range(0, 8) r(k) group by 1),
  l as (select doc_id, source, t, x, trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '{_SPACE}+', ' ', 'g')) as norm
    from d, unnest(string_split(t, chr(10))) u(x) where regexp_matches(x, '[^ \t-\r]')),
  hosts as (select source, count(distinct t) as host_docs from d group by 1),
  frequent as (select l.source, norm from l join hosts on l.source is not distinct from hosts.source group by l.source, norm, host_docs
    having count(distinct t) > {quality.MAX_LINE_DOCS} and (len(string_split(norm, ' ')) >= {quality.LONG_LINE_WORDS} or 100 * count(distinct t) > {quality.MAX_LINE_PERCENT} * host_docs)),
  line_sums as (select doc_id, count(*) - count(distinct x) as n_dup_lines, count(f.norm) as n_removed_lines, sum(length(x)) as total,
      coalesce(sum(length(x)) filter (f.norm is not null), 0) as removed
    from l left join frequent f on l.norm = f.norm and l.source is not distinct from f.source group by doc_id),
  m as (select w.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
      coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n, 0) as n_repeat_words, coalesce(n_removed_lines, 0) as n_removed_lines,
      coalesce(100 * removed > {quality.MAX_REMOVED_PERCENT} * total, false) as depleted
    from w left join covered using (doc_id) left join line_sums using (doc_id))
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and not depleted as kept from m""",
    "op7_warc": f"""with p as (select page_id, coalesce(html, '') as h from pages),
  x as (select page_id, strlen(h) as payload_bytes, sha256(h) as payload_digest, min(page_id) over (partition by h) as first from p)
  select page_id, payload_bytes, payload_digest, case when payload_bytes >= {warc.LEAST_BYTES} and page_id <> first then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= {warc.LEAST_BYTES} and page_id <> first then first end as refers_to from x""",
    "op8_nn_descent": f"""with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null and len(embedding) > 0),
  l as (select a.vec_id as u, b.vec_id as v from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= {nndescent.THRESHOLD}),
  reach(u, r) as (select vec_id, vec_id from embeddings union select l.u, reach.r from reach join l on l.v = reach.u),
  n as (select u, count(*) as n_links from l group by u)
  select reach.u as vec_id, coalesce(any_value(n_links), 0) as n_links, min(r) as component_id, reach.u = min(r) as kept from reach left join n on n.u = reach.u group by reach.u""",
    "op12_runs": rf"""with bytes as (select doc_id, text, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint)) as b from documents),
  sums as (select doc_id, text, xor(list_reduce(list_prepend(cast(4294967295 as bigint), b),
      lambda s, x: list_reduce(list_prepend(xor(s, x), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) as h from bytes),
  d as (select doc_id, h, h // 10 as g, [x for x in string_split_regex(coalesce(text, ''), '{_SPACE}+') if x <> ''] as o from sums),
  e as (select *, len(o) as n, case when len(o) > 0 then g % len(o) end as a from d),
  f as (select doc_id, n, case when h % 10 = 0 and n > 0
      then list_transform(range(n), lambda i: o[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) else o end as w from e),
  seeds as (select doc_id, i, list_slice(w, i + 1, i + 6) as k from f, unnest(range(0, n - 5)) u(i)),
  pairs as (select x.doc_id, x.i, y.i - x.i as q from seeds x join seeds y on x.doc_id = y.doc_id and x.k = y.k and x.i < y.i),
  islands as (select doc_id, q, min(i) as start, max(i) - min(i) + 6 as m from
    (select *, i - row_number() over (partition by doc_id, q order by i) as island from pairs) group by doc_id, q, island),
  stretches as (select doc_id, start, m + q as length, q as period from islands where m >= greatest(q, 12 - q)),
  r as (select doc_id, start, length, min(period) as period from stretches group by 1, 2, 3),
  dropped as (select distinct doc_id, i from r, unnest(range(start + period, start + length)) u(i)),
  gone as (select doc_id, list(i) as z from dropped group by 1),
  s as (select doc_id, count(*) as n_runs, arg_max((start, length, period), (length, -start, -period)) as best,
      string_agg(concat(start, ',', length, ',', period, chr(10)), '' order by start, period) as lines from r group by 1)
  select f.doc_id, coalesce(n_runs, 0) as n_runs, best[1] as start, best[2] as length, best[3] as period, 1000 * best[2] // best[3] as exponent_milli,
    sha256(coalesce(lines, '')) as runs_sha256,
    sha256(array_to_string(case when z is null then w else list_transform(list_filter(range(n), lambda i: not list_contains(z, i)), lambda i: w[i + 1]) end, ' ')) as collapsed_sha256
  from f left join s using (doc_id) left join gone using (doc_id)""",
    "op13_topk": """with v as (select vec_id, list_transform(embedding, lambda c: floor(256 * cast(c as double))) as x from embeddings where vec_id is not null
    and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
  s as (select q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.x, v.x) as bigint) as score from v q join v on q.vec_id % 50 = 0 and q.vec_id <> v.vec_id)
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s
  qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5""",
}
