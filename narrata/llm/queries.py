"""The registered queries of this subpackage: each operator over its whole table, and the result columns asked for."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import functions as F

from narrata.llm import (
    ann, collocations, embedding_dedup, packing, quality, runs, sampled_pieces, simhash, substrings, suffix_tree, toxicity, urls, warc,
)
from narrata.llm.base import fold, table


def op1_balanced_posting_lists(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20)


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    judged = toxicity.with_judgement(docs, field, "judged")
    return judged.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "judged.score", "judged.spans").select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), "spans"
    )


def op3_suffix_tree_lm(spark, sf_dir):
    scored = suffix_tree.score_documents(table(spark, sf_dir, "documents"), folds=7, held_out=2)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_sampled_sentencepiece(spark, sf_dir):
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sampled_pieces.encode(table(spark, sf_dir, "documents"), vocabulary, heat=0.5, seed=4)
    decoded = sampled_pieces.decode_rows(encoded, vocabulary)
    return decoded.select("doc_id", "n_ids", "ids_crc32", F.sha2(F.col("text"), 256).alias("decoded_sha256"))


def op5_simhash_near_dedup(spark, sf_dir):
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op6_substring_dedup(spark, sf_dir):
    kept = substrings.strip_repeats(table(spark, sf_dir, "documents"))
    return kept.select("row.doc_id", "cut.n_words", "cut.n_removed", "cut.kept_sha256")


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]  # fixed values


def op7_url_filter(spark, sf_dir):
    judged = urls.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op8_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_score(docs, model, "score")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op10_best_fit_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024, end=2)


def op11_collocations(spark, sf_dir):
    tables, totals = collocations.phrases(table(spark, sf_dir, "documents"), least=100)
    best = collocations.top(collocations.scored(tables, totals), 2000)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _repeating_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document by the hash of its id repeats some of its words to the end."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


def op12_periodic_runs(spark, sf_dir):
    found = runs.with_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=_repeating_tail)
    return found.select("row.doc_id", *[c.alias(name) for name, c in runs.run_columns().items()])


def op13_warc_index_merge(spark, sf_dir):
    second = F.timestamp_add("SECOND", F.col("page_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    captures = warc.capture_histories(table(spark, sf_dir, "pages"), "page_id", "url", "html", at=second)
    return captures.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    f.__name__: f
    for f in (
        op1_balanced_posting_lists,
        op2_toxicity,
        op3_suffix_tree_lm,
        op4_sampled_sentencepiece,
        op5_simhash_near_dedup,
        op6_substring_dedup,
        op7_url_filter,
        op8_quality_classifier,
        op9_embedding_near_dedup,
        op10_best_fit_packing,
        op11_collocations,
        op12_periodic_runs,
        op13_warc_index_merge,
    )
}

ORACLES: dict[str, str] = {
    "op11_collocations": """
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents
), split as (
  select lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') as w from pieces
), totals as (
  select lang, cast(sum(len(w)) as bigint) as n from split group by lang
), starts as (
  select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from split, (select unnest([1, 2, 3, 4, 5]) as k) where len(w) >= k
), counts as (
  select lang, k, w[i:i + k - 1] as ws, count(*) as f from starts group by lang, k, w[i:i + k - 1]
), candidates as (
  select lang, k, ws, f from counts where k >= 2 and f >= 100
), inside as (
  select lang, k, ws, f, unnest(range(1, k)) as i from candidates where k > 2
), held as (
  select lang, f, ws[i:j] as ws from (select lang, k, ws, f, i, unnest(range(i + 1, k + 1)) as j from inside) where j - i + 1 < k
), kept as (
  select c.* from candidates c where not exists (select 1 from held h where h.lang = c.lang and h.ws = c.ws and h.f >= c.f)
), cuts as (
  select lang, k, ws, f as a, unnest(range(1, k)) as "at" from kept
), scores as (
  select c.lang, c.ws, c.k, c."at", c.a, x.f as l, y.f as r, t.n,
    cast((cast(1000 as hugeint) * c.a * t.n) // (cast(x.f as hugeint) * y.f) as bigint) as score
  from cuts c join counts x on x.lang = c.lang and x.ws = c.ws[1:c."at"] join counts y on y.lang = c.lang and y.ws = c.ws[c."at" + 1:c.k]
  join totals t on t.lang = c.lang
), lowest as (
  select *, array_to_string(ws, ' ') as phrase from scores qualify row_number() over (partition by lang, ws order by score, "at") = 1
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from lowest qualify rank <= 2000""",
    "op13_warc_index_merge": """
with p as (
  select page_id, coalesce(html, '') as h, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes from pages
), q as (
  select page_id, payload_bytes, sha1(h) as payload_digest, payload_bytes >= 1000 and page_id < max(page_id) over (partition by h) as revisits,
    max(page_id) over (partition by h) as last
  from p
)
select page_id, payload_bytes, payload_digest, case when revisits then 'revisit' else 'response' end as record_type,
  case when revisits then last end as refers_to
from q""",
}
