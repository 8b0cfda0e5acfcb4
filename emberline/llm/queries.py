"""The queries of this subpackage, for the entry point."""

from __future__ import annotations

from emberline.llm import decontamination, hard_negatives, mixing, ngram_join, pii, quality, quality_classifier, secret_scan, sharding, spelling, substring_dedup, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        warc.op1_warc,
        substring_dedup.op2_substring_dedup,
        decontamination.op3_decontamination,
        ngram_join.op4_ngram_join,
        mixing.op5_mixing,
        pii.op6_pii,
        quality.op7_quality,
        sharding.op8_sharding,
        secret_scan.op9_secret_scan,
        toxicity.op10_toxicity,
        spelling.op11_spelling,
        hard_negatives.op12_hard_negatives,
        quality_classifier.op13_quality_classifier,
    )
}
#: SQL of the queries whose whole result SQL can express.
ORACLES: dict[str, str] = {
    # a payload's SHA-1 in base 32: eight characters for every five bytes
    "op1_warc": """with p as (select page_id, url, encode(coalesce(html, '')) as payload from pages),
 d as (select *, sha1(payload) as hex, min(page_id) over (partition by payload) as least from p)
 select page_id, octet_length(payload) as payload_bytes, array_to_string(flatten(list_transform([0, 1, 2, 3], lambda g: list_transform([35, 30, 25, 20, 15, 10, 5, 0], lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((cast('0x' || substr(hex, g * 10 + 1, 10) as bigint) >> s) & 31) + 1]))), '') as payload_digest,
 case when page_id = least then 'response' else 'revisit' end as record_type, case when page_id <> least then least end as refers_to, url from d""",
    # windows of 35 words by their words; those that start at two places or more cover what goes
    "op2_substring_dedup": r"""with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
 s as (select r, unnest(range(1, len(w) - 33)) as i, w from d where len(w) >= 35), k as (select r, i, array_to_string(w[i:i + 34], ' ') as window_words from s),
 many as (select window_words from k group by 1 having count(*) > 1), gone as (select distinct r, i + j as place from k join many using (window_words) cross join (select unnest(range(35)) as j) as o),
 each as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as place from d), kept as (select r, string_agg(word, ' ' order by place) as t from each anti join gone using (r, place) group by 1), n as (select r, count(*) as n from gone group by 1)
 select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join n using (r) left join kept using (r)""",
    "op12_hard_negatives": """with e as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select a.r, a.vec_id as a, b.vec_id as b, a.label = b.label as same, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda x: coalesce(x[1] * x[2], 0))) as bigint) as score from e a join e b on a.r <> b.r where a.vec_id % 50 = 0),
 p as (select r, a, b, score, row_number() over (partition by r order by score desc, b) as k from s where same qualify k <= 5),
 n as (select p.a as anchor_id, p.b as positive_id, cast(row_number() over (partition by p.r, p.k order by s.score desc, s.b) as int) as rank, s.b as negative_id, p.score as positive_score, s.score as negative_score
  from p join s on p.r = s.r and not s.same where 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score qualify rank <= 3)
 select * from n""",
}
