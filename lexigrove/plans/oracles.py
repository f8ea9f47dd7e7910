"""SQL for DuckDB, by query. Views are named as the tables."""

from __future__ import annotations

from lexigrove.operators.tfidf import STOP_WORDS

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

PROPOSALS = """props as (
  select 'p1' as proposal, doc_id as text_id, lang as cluster from documents where doc_id % 5 <> 0
  union all select 'p2', doc_id, source from documents where doc_id % 5 <> 1
  union all select 'p3', doc_id, 'b' || cast(n_chars // 1000 as varchar) from documents where doc_id % 5 <> 2),
pairs as (select x.proposal as a, y.proposal as b, x.text_id, x.cluster as ca, y.cluster as cb from props x join props y on x.text_id = y.text_id and x.proposal < y.proposal),
cells as (select a, b, ca, cb, count(*) as n from pairs group by all),
ra as (select a, b, ca, sum(n) as m from cells group by all),
rb as (select a, b, cb, sum(n) as m from cells group by all),
tot as (select a, b, sum(n)::double as n from cells group by all)"""

SCORES = """sij as (select a, b, sum(n * (n - 1) / 2.0) as s from cells group by all),
sa as (select a, b, sum(m * (m - 1) / 2.0) as s from ra group by all),
sb as (select a, b, sum(m * (m - 1) / 2.0) as s from rb group by all),
ha as (select r.a, r.b, sum(-(r.m / t.n) * ln(r.m / t.n)) as h from ra r join tot t using (a, b) group by all),
hb as (select r.a, r.b, sum(-(r.m / t.n) * ln(r.m / t.n)) as h from rb r join tot t using (a, b) group by all),
mi as (select c.a, c.b, sum(c.n / t.n * ln(c.n * t.n / (ra.m * rb.m))) as i from cells c join tot t using (a, b) join ra using (a, b, ca) join rb using (a, b, cb) group by all),
scores as (select t.a, t.b, t.n::bigint as n, (sij.s - sa.s * sb.s / (t.n * (t.n - 1) / 2)) / ((sa.s + sb.s) / 2 - sa.s * sb.s / (t.n * (t.n - 1) / 2)) as ari, mi.i / ((ha.h + hb.h) / 2) as nmi
  from tot t join sij using (a, b) join sa using (a, b) join sb using (a, b) join ha using (a, b) join hb using (a, b) join mi using (a, b))"""

ASSIGNED = """asg as (select doc_id % 4 as audit_id, (doc_id % 4 % 2)::int as cluster_version, doc_id as text_id,
  case when doc_id % 7 = 0 then '' else 'c' || (quality * 2 + toxic)::varchar end as cluster_id, case when doc_id % 11 = 0 then null else (1 + doc_id % 5)::double end as confidence from labels),
names as (select * from (values ('c0', 'junk'), ('c1', 'rude junk'), ('c2', 'prose'), ('c9', 'none such')) t(cluster_id, name))"""

TERMS = f"""tok as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) as term from corpus),
tf as (select doc_id, term, count(*) as tf from tok where term not in ({STOP}) group by all),
vocab as (select term, sum(tf) as total, count(*) as df from tf group by all order by total desc, term limit 10000),
n as (select count(*) as n from corpus),
w as (select doc_id, term, tf * (ln((1 + n) / (1.0 + df)) + 1) as w, ln((1 + n) / (1.0 + df)) + 1 as idf from tf join vocab using (term), n),
q as (select term, count(*) as qtf from (select unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) as term from documents where doc_id = 7) group by all),
len as (select sqrt(sum((qtf * (ln((1 + n) / (1.0 + df)) + 1)) ** 2)) as l from vocab join q using (term), n),
dots as (select doc_id, sum(w * coalesce(qtf, 0) * idf) as dot, sqrt(sum(w * w)) as norm from w left join q using (term) group by all)"""

CENTROIDS = """flat as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
cent as (select label, i, avg(x) as x from flat group by all),
vflat as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
sims as (select v.vec_id, c.label, round(sum(v.x * c.x) / sqrt(sum(v.x * v.x) * sum(c.x * c.x)), 10) as s from vflat v join cent c using (i) group by all),
near as (select vec_id, label, s from sims qualify row_number() over (partition by vec_id order by s desc, label) = 1),
pred as (select e.vec_id, e.label, (case when e.vec_id % 7 = 0 then -1 when e.vec_id % 3 = 0 then n.label % 4 else n.label end)::int as predicted, (e.vec_id % 2)::int as seed from embeddings e join near n using (vec_id))"""

NAMES = "['the', 'th', 'de', 'en', 'er', 'qu']"
ANSWERS = f"""a as (select conv_id * 100 + turn as id, case turn % 5 when 4 then '' when 3 then case when conv_id % 2 = 0 then '{{"x": "artful theme", "a": "qu"}}' else '{{"the": "' || role || '"}}' end when 2 then '"' || role || '"' else text end as t from conversations),
o as (select id, t, case when json_valid(t) then json_type(t) end as kind, case when json_valid(t) and json_type(t) = 'OBJECT' then list_transform(json_keys(t), lambda k: json_extract_string(t, k)) end as vals from a),
res as (select id, case when t is null then '<unparseable>' when kind = 'OBJECT' then coalesce(list_filter(vals, lambda v: list_contains({NAMES}, v))[1], flatten(list_transform(vals, lambda v: list_filter({NAMES}, lambda n: contains(v, n))))[1], '<hallucinated>')
  when kind is null or kind = 'NULL' then coalesce(list_filter({NAMES}, lambda n: contains(t, n))[1], '<unparseable>') else coalesce(list_filter({NAMES}, lambda n: contains(json_extract_string(t, '$'), n))[1], '<hallucinated>') end as label from o)"""


REQUESTS = r"""r as (select doc_id, text as t, row_number() over (order by md5('0:' || doc_id::varchar), doc_id) - 1 as r from documents),
c as (select r // 15 as chunk, string_agg('- ' || t, chr(10) order by r) as u from r group by all),
req as (select printf('chunk-%06d', chunk) as custom_id, '{"custom_id":"' || printf('chunk-%06d', chunk) || '","method":"POST","url":"/v1/chat/completions","body":{"model":"small-model","messages":[{"role":"system","content":"Name a topic for each text."},{"role":"user","content":' || to_json(u)::varchar || '}],"max_completion_tokens":4000}}' as request from c)"""


def _scores_of(method: str, guess: str) -> str:
    """ARI and NMI of ``guess`` against the label, by seed."""
    m = method
    return f"""{m}_c as (select seed, label as x, {guess} as y, count(*)::double as n from pred group by all),
{m}_t as (select seed, sum(n) as n from {m}_c group by all), {m}_a as (select seed, x, sum(n) as m from {m}_c group by all), {m}_b as (select seed, y, sum(n) as m from {m}_c group by all),
{m}_s as (select seed, t.n, (select sum(n * (n - 1) / 2) from {m}_c c where c.seed = t.seed) as s, (select sum(m * (m - 1) / 2) from {m}_a c where c.seed = t.seed) as sa, (select sum(m * (m - 1) / 2) from {m}_b c where c.seed = t.seed) as sb,
  (select sum(-(m / t.n) * ln(m / t.n)) from {m}_a c where c.seed = t.seed) as ha, (select sum(-(m / t.n) * ln(m / t.n)) from {m}_b c where c.seed = t.seed) as hb,
  (select sum(c.n / t.n * ln(c.n * t.n / (a.m * b.m))) from {m}_c c join {m}_a a on a.seed = c.seed and a.x = c.x join {m}_b b on b.seed = c.seed and b.y = c.y where c.seed = t.seed) as mi from {m}_t t),
{m} as (select avg((s - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2))) as ari, avg(mi / ((ha + hb) / 2)) as nmi from {m}_s)"""


ORACLE_SQL = {
    "q01_doc_id_format": "select doc_id, printf('docs-%s-%06d', lang, doc_id) as name from documents",
    "q02_none_mapping": "select doc_id, (case when k = 1 then -1 else k end)::int as gold_label_id, case when k = 1 then '__none__' else 'k' || k::varchar end as gold_label_name, k = 1 as is_none from (select doc_id, quality * 2 + toxic as k from labels)",
    "q02b_label_compaction": "select source, (row_number() over (order by first, source) - 1)::int as label_id from (select source, min(doc_id) as first from documents where source <> 'src3' group by all)",
    "q03_token_cap": r"select doc_id, case when len(p) > 50 then array_to_string(p[1:50], ' ') else text end as capped, len(p) > 50 as truncated from (select doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]') as p from documents)",
    "q04_dataset_validation": """with d as (select d.doc_id, d.text, (quality * 2 + toxic - 1)::int as label from documents d left join labels l using (doc_id))
select count(*) as n_docs, count(*) - count(distinct doc_id) as duplicate_ids, count(*) filter (where coalesce(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '') = '') as blank_texts,
count(*) filter (where label < -1 or label >= 4) as labels_out_of_range, 0::bigint as none_mismatches, (4 - count(distinct case when label >= 0 then label end))::bigint as labels_missing from d""",
    "q05_corpus_alignment": "select count(a.doc_id) as n_left, count(b.item_id) as n_right, count(*) filter (where a.doc_id is null or b.item_id is null or a.text is distinct from b.text) as mismatches from documents a full outer join benchmark b on a.doc_id = b.item_id",
    "q06_corpus_length_stats": "select round_even(avg(length(text)), 0)::bigint as avg_length, round_even(median(length(text)), 0)::bigint as median_length, round_even(quantile_cont(length(text), 0.95), 0)::bigint as p95_length, min(length(text))::bigint as min_length, max(length(text))::bigint as max_length from documents",
    "q07_unseen_candidates": "select doc_id, source from documents where doc_id not in (select doc_id from labels)",
    "q07b_seen_union": "select doc_id from labels union select conv_id from conversations",
    "q08_fetch_by_ids": "select r.pos::bigint as pos, r.doc_id::bigint as doc_id, d.text from (values (0, 5), (1, 3), (2, 5), (3, 99999999), (4, 42)) r(pos, doc_id) left join documents d on d.doc_id = r.doc_id",
    "q09_dataset_meta": "select lang, count(*) as n_docs, count(*) filter (where source = 'src3') as n_none, round(avg(length(text)), 6) as mean_text_chars, round(count(*) filter (where source = 'src3') / count(*)::double, 6) as share_none from documents group by all",
    "q10_confidence_normalise": """with r as (select doc_id % 8 as audit_id, doc_id as text_id, (case doc_id % 8 when 0 then 1.0 + (doc_id // 8) % 5 when 1 then (doc_id // 8) % 5 / 4.0 when 2 then 1 when 3 then (doc_id // 8) % 2 when 4 then 0 when 5 then (doc_id // 8) % 3 - 1.0 when 6 then (doc_id // 8) % 15 / 2.0 end)::double as confidence from labels),
s as (select audit_id, min(confidence) as lo, max(confidence) as hi, bool_or(confidence <> floor(confidence)) as frac, bool_or(confidence < 1 or confidence > 5) as outside from r group by all)
select audit_id, text_id, confidence, (case when confidence is null then null when hi <= 1 and frac then greatest(1, least(5, round_even(confidence * 5, 0))) when lo = 1 and hi = 1 then confidence when lo = 0 and hi = 1 then greatest(1, least(5, confidence * 5))
 when lo = 0 and hi = 0 then 1 when hi <= 1 then greatest(1, least(5, round_even(confidence, 0))) when outside or frac then greatest(1, least(5, round_even(confidence, 0))) else confidence end)::double as normalised from r join s using (audit_id)""",
    "q11_assignment_stats": f"with {ASSIGNED} select audit_id, count(*) as total, count(*) filter (where cluster_id <> '') as assigned, round(avg(confidence), 6) as mean_confidence, count(*) filter (where cluster_id = '') as unclustered, round(count(*) filter (where cluster_id <> '') / count(*)::double, 6) as coverage from asg group by all",
    "q12_size_distribution": f"with {ASSIGNED}, c as (select audit_id, cluster_id, count(*) as n from asg where cluster_id <> '' group by all) select audit_id, min(n) as min_size, max(n) as max_size, round(avg(n), 6) as mean_size from c group by all",
    "q13_audit_metrics_report": f"with {ASSIGNED}, c as (select cluster_id, count(*) as n, avg(confidence) as m from asg where cluster_id <> '' and cluster_version = 1 group by all) select cluster_id, coalesce(name, 'unknown') as name, n, round(m, 6) as mean_confidence, case when m is null then 'unaudited' when m >= 4 then 'high' when m >= 3 then 'medium' else 'low' end as label from c left join names using (cluster_id)",
    "q13b_confidence_histogram": f"with {ASSIGNED} select confidence, count(*) as n from asg where confidence is not null group by all",
    "q14_audit_update": f"""with {ASSIGNED}, c as (select cluster_id, count(confidence) as n, sum(confidence) as s from asg where cluster_id <> '' and cluster_version = 1 group by all having count(confidence) > 0),
b as (select * from (values ('c0', 10, 5.0), ('c2', 4, 2.5), ('c9', 7, 3.0)) t(cluster_id, n1, m1)),
u as (select cluster_id, name, n, coalesce(n1, 0) as n1, m1::double as m1, case when n is null then m1 else (coalesce(m1::double * n1, 0) + s) / (coalesce(n1, 0) + n) end as m from names left join c using (cluster_id) left join b using (cluster_id))
select cluster_id, name, (n1 + coalesce(n, 0))::bigint as audit_assignments, case when n is null then m1 else round(m, 2) end as audit_mean_confidence, case when m is null then 'unaudited' when m >= 4 then 'high' when m >= 3 then 'medium' else 'low' end as confidence, case when n is null then 'proposed' else 'audited' end as status from u""",
    "q15_common_texts": f"with {PROPOSALS} select a, b, count(*) as n_common, count(*) filter (where ca < cb) as n_less from pairs group by all",
    "q16_contingency": f"with {PROPOSALS} select a, b, ca, cb, n from cells",
    "q16b_agreement_rate": f"with {PROPOSALS}, top as (select a, b, ca, max(n) as top, sum(n) as n from cells group by all) select a, b, sum(n)::bigint as n_common, round(sum(top) / sum(n)::double, 6) as agreement from top group by all",
    "q17_high_entropy_clusters": f"""with {PROPOSALS}, e as (select a, b, 'a' as side, ca as cluster, sum(-(n / m) * log2(n / m)) as e, sum(n)::bigint as n from cells join ra using (a, b, ca) group by all
 union all select a, b, 'b', cb, sum(-(n / m) * log2(n / m)), sum(n)::bigint from cells join rb using (a, b, cb) group by all)
select a, b, side, cluster, round(e, 6) as entropy, n, (row_number() over (partition by a, b order by round(e, 10) desc, side, cluster))::int as rank from e where e > 1e-12 qualify rank <= 10""",
    "q18_ari_nmi": f"with {PROPOSALS}, {SCORES} select a, b, n, round(ari, 6) as ari, round(nmi, 6) as nmi from scores",
    "q20_agreement_summary": f"with {PROPOSALS}, {SCORES}, m as (select avg(ari) as m, count(*) as c from scores) select round(m, 6) as mean_ari, c as pairs, case when m > 0.65 then 'strong' when m > 0.25 then 'moderate' else 'weak' end as label from m",
    "q21_element_similarity": f"with {PROPOSALS}, two as (select x.text_id, (x.ca = y.ca) = (x.cb = y.cb) as same from pairs x join pairs y on x.a = y.a and x.b = y.b and x.text_id <> y.text_id) select text_id, round(avg(same::int), 6) as similarity from two group by all",
    "q22_inconsistent_preview": f"""with {PROPOSALS}, two as (select x.text_id, (x.ca = y.ca) = (x.cb = y.cb) as same from pairs x join pairs y on x.a = y.a and x.b = y.b and x.text_id <> y.text_id), s as (select text_id, avg(same::int) as s from two group by all order by round(s, 10), text_id limit 20)
select text_id, round(s, 6) as similarity, case when length(text) > 300 then substring(text, 1, 300) || '...' else text end as preview from s join documents on doc_id = text_id""",
    "q24_tfidf_search": f"with corpus as (select doc_id, text from documents), {TERMS} select doc_id, round(dot / (norm * l), 6) as similarity from dots, len where dot > 0 order by round(dot / (norm * l), 10) desc, doc_id limit 20",
    "q24b_targeted_sample": f"with corpus as (select doc_id, text from documents where doc_id not in (select doc_id from labels) union all select null, text from documents where doc_id = 7), {TERMS} select doc_id, round(dot / (norm * l), 6) as similarity from dots, len where dot > 0 and doc_id is not null order by round(dot / (norm * l), 10) desc, doc_id limit 15",
    "q44_random_sample": "select doc_id, source from documents order by md5('42:' || doc_id::varchar), doc_id limit 25",
    "q45_cluster_sample": f"with {ASSIGNED} select doc_id, lang from documents where doc_id in (select text_id from asg where cluster_version = 1 and cluster_id = 'c2') order by md5('7:' || doc_id::varchar), doc_id limit 10",
    "q25_set_clusters": """with new as (select source as name, min(doc_id) as ord from documents group by all), old as (select * from (values ('src2', 'c4', '7,8'), ('src5', 'c11', '9')) t(k, id, ev)),
b as (select ord, name, id, ev from new left join old on lower(trim(name)) = k)
select ord, coalesce(id, 'c' || (11 + row_number() over (partition by id is null order by ord))::varchar) as cluster_id, name, 'from ' || name as description, case when ord % 2 = 0 then ord::varchar else coalesce(ev, '') end as evidence from b""",
    "q26_finalize_examples": f"""with {ASSIGNED}, best as (select cluster_id, text_id, max(confidence) as c from asg where cluster_id <> '' and cluster_version = 1 group by all),
r as (select *, row_number() over (partition by cluster_id order by c desc nulls last, text_id) as rank from best)
select cluster_id, name, (rank - 1)::int as pos, text_id::varchar as text_id, length(text)::int as n_chars from r join names using (cluster_id) join documents on doc_id = text_id where rank <= 5""",
    "q27_merge_clusters": """with l as (select 'c' || (quality * 2 + toxic)::varchar as cid, doc_id, 1.0 + doc_id % 5 as c from labels), g as (select cid, string_agg(doc_id::varchar, ',' order by doc_id) as ev, count(*) as n, avg(c) as m from l group by all),
t as (select case when cid in ('c0', 'c1', 'c3') then 'c3' else cid end as cluster_id, case cid when 'c3' then 0 when 'c1' then 1 when 'c0' then 2 else 0 end as r, * from g)
select cluster_id, case when cluster_id = 'c3' then 'merged' else 'name ' || cluster_id end as name, string_agg(ev, ',' order by r) as evidence, sum(n)::bigint as audit_assignments, round(sum(n * m) / sum(n), 6) as audit_mean_confidence, case when count(*) > 1 then 'modified' else 'audited' end as status from t group by cluster_id""",
    "q28_split_check": """with p as (select doc_id from labels where quality = 1 and toxic = 1), b as (select doc_id, unnest(case when doc_id % 6 = 0 then [0, 1] when doc_id % 5 <> 0 then [doc_id % 2] else [] end) as k from labels where toxic = 1)
select 'overlap' as problem, doc_id as text_id from b group by doc_id having count(distinct k) > 1 union select 'missing', doc_id from p where doc_id not in (select doc_id from b) union select 'extra', doc_id from b where doc_id not in (select doc_id from p)""",
    "q29_chat_requests": f"with recursive {REQUESTS} select custom_id, request from req",
    "q29b_request_files": f"""with recursive {REQUESTS},
line as (select custom_id, strlen(request) + 1 as size, row_number() over (order by custom_id) as i from req),
fill as (select custom_id, i, 0::bigint as file, 1 as n, size as held from line where i = 1
  union all select l.custom_id, l.i, f.file + (f.n + 1 > 10 or f.held + l.size > 2500000)::int, case when f.n + 1 > 10 or f.held + l.size > 2500000 then 1 else f.n + 1 end, case when f.n + 1 > 10 or f.held + l.size > 2500000 then l.size else f.held + l.size end
  from fill f join line l on l.i = f.i + 1) select custom_id, file from fill""",
    "q47c_assigned_outliers": """with flat as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
cent as (select label, i, avg(x) as x from flat where vec_id % 7 <> 0 group by all),
sims as (select v.vec_id, c.label, round(sum(v.x * c.x) / sqrt(sum(v.x * v.x) * sum(c.x * c.x)), 10) as s from flat v join cent c using (i) where v.vec_id % 7 = 0 group by all),
near as (select vec_id, label from sims qualify row_number() over (partition by vec_id order by s desc, label) = 1)
select e.vec_id, coalesce(n.label, e.label)::int as cluster from embeddings e left join near n using (vec_id)""",
    "q30_label_union": "select label, min(ord) as first from (select doc_id as ord, case when doc_id % 9 = 0 then 'unknown_topic 1' else lang || '/' || source end as label from documents) where not contains(label, 'unknown_topic') group by all",
    "q30b_merged_labels": "select conv_id * 100 + turn as id, case conv_id % 4 when 0 then case when role = 'b' then 'b' else 'b|' || role end when 1 then case when role = 'x' then 'x' else 'x|' || role end end as labels from conversations",
    "q31_response_resolution": f"with {ANSWERS} select id, label from res",
    "q31b_correction_targets": f"with {ANSWERS} select count(*) as n_total, count(*) filter (where label = '<unparseable>') as n_error, count(*) filter (where label = '<hallucinated>') as n_hallucinated, count(*) filter (where label in ('<unparseable>', '<hallucinated>')) as n_to_correct from res",
    "q31c_topic_fallback": """with t as (select conv_id * 100 + turn as id, case when (conv_id * 100 + turn) % 3 = 0 then null when (conv_id * 100 + turn) % 4 <> 1 and role in ('user', 'assistant') then role else 'Café & co' end as topic from conversations),
f as (select topic from t where topic is not null group by all order by count(*) desc, min(id) limit 1) select id, coalesce(t.topic, f.topic) as topic from t, f""",
    "q32_triplet_resume": "select vec_id as query_idx, (vec_id * 7 + 1) % 100 as choice1_idx, (vec_id * 3 + 2) % 100 as choice2_idx from embeddings where vec_id not in (select doc_id from labels)",
    "q32b_triplet_convert": "select vec_id as query_idx, case vec_id % 4 when 0 then (vec_id * 7 + 1) % 100 else (vec_id * 3 + 2) % 100 end as pos_idx, case vec_id % 4 when 0 then (vec_id * 3 + 2) % 100 else (vec_id * 7 + 1) % 100 end as neg_idx from embeddings where vec_id % 4 < 2",
    "q33_output_validation": """with e as (select event_id, event_id % 3 as k, case when event_id % 10 = 0 then null else json_keys(props) end as keys from events)
select event_id, coalesce(keys is not null and k <> 2 and list_contains(keys, 'k') and (k = 0 or list_contains(keys, 'clusters')), false) as valid,
case k when 2 then null when 0 then case when list_contains(coalesce(keys, []), 'k') then '' else 'k' end else array_to_string(list_filter(['clusters', 'k'], lambda x: not list_contains(coalesce(keys, []), x)), ',') end as missing from e""",
    "q34_predictions": """with l as (select doc_id, case when doc_id % 10 = 7 then '3' when doc_id % 5 = 0 then 'none' when doc_id % 5 = 1 then '' else (quality * 2 + toxic)::varchar end as c, (1 + doc_id % 5)::double as conf from labels)
select d.doc_id, d.lang, case when c is null or c in ('', 'none') then -1 else c::int end as predicted_cluster_id, round(conf / 5, 6) as confidence from documents d left join l using (doc_id)""",
    "q46_match_responses": "select coalesce(a.i, b.i)::varchar as custom_id, case when b.i is null then 'missing' when a.i is null then 'unknown' else 'ok' end as status from (select doc_id as i from labels) a full outer join (select distinct conv_id as i from conversations) b on a.i = b.i",
    "q35_best_cells": f"with {CENTROIDS}, {_scores_of('nearest', 'predicted')}, {_scores_of('fixed', 'vec_id % 4')}, u as (select 'nearest' as method, 'ari' as metric, ari as v from nearest union all select 'nearest', 'nmi', nmi from nearest union all select 'fixed', 'ari', ari from fixed union all select 'fixed', 'nmi', nmi from fixed) select 'given-k' as panel, method, 'embeddings' as dataset, metric, round(v, 6) as value, round(v, 6) = max(round(v, 6)) over (partition by metric) as best from u",
    "q36_predicted_k": f"with {CENTROIDS} select seed, nullif(count(distinct case when predicted >= 0 then predicted end), 0) as predicted_k from pred group by all",
    "q37_token_cost": """with u as (select role, sum(length(text))::bigint as i, sum(case when turn > 0 then length(text) else 0 end)::bigint as c, sum(length(text) // 3)::bigint as o, count(*) as n from conversations group by all)
select role, i as input_tokens, c as cache_tokens, o as output_tokens, n as n_responses, round(c / (c + i)::double, 6) as cache_hit_rate, round((i * 0.125 + c * 0.0125 + o * 1.0)::double / 1e6, 6) as usd from u""",
    "q38_texts_sha256": "select lang, sha256(string_agg(text || chr(0), '' order by doc_id)) as texts_sha256 from documents group by all",
    "q39_recent_log": "select event_id, event_type from events order by ts desc, event_id desc limit 5",
    "q42_c_tf_idf": f"""with tok as (select lang, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) as term from documents), tf as (select lang, term, count(*) as tf from tok where term not in ({STOP}) group by all),
tot as (select term, sum(tf) as t from tf group by all), sz as (select lang, sum(tf)::double as w from tf group by all), m as (select avg(w) as m from sz),
s as (select lang, term, tf / w * ln(1 + m / t) as s from tf join tot using (term) join sz using (lang), m)
select lang, term, round(s, 6) as score, (row_number() over (partition by lang order by round(s, 10) desc, term))::int as rank from s qualify rank <= 10""",
    "q43_nearest_centroid": f"with {CENTROIDS} select vec_id, label, round(s, 6) as similarity from near",
    "q24c_stored_search": f"with corpus as (select doc_id, text from documents), {TERMS} select doc_id, round(dot / (norm * l), 6) as similarity from dots, len where dot > 0 order by round(dot / (norm * l), 10) desc, doc_id limit 20",
    "q50_label_space": "select name, (row_number() over (order by name) - 1)::int as label_id from (select lang as name from documents union select source from documents union select role from conversations) where name is not null",
    "q51_concatenated_splits": "select doc_id::varchar as id, text, lang, 'train' as source_split from documents union all select item_id::varchar, text, null, 'test' from benchmark",
    "q52_single_label_counts": "select count(*) filter (where k = 1) as kept, count(*) filter (where k <> 1) as rejected from (select conv_id, count(distinct role) as k from conversations group by all)",
    "q53_triplet_texts": "with t as (select vec_id as query_idx, (vec_id * 7 + 1) % 100 as choice1_idx, (vec_id * 3 + 2) % 100 as choice2_idx from embeddings) select t.*, q.text as query, a.text as choice1, b.text as choice2 from t join documents q on q.doc_id = query_idx join documents a on a.doc_id = choice1_idx join documents b on b.doc_id = choice2_idx",
    "q54_label_ids": f"with {ANSWERS} select id, case when list_contains({NAMES}, label) then (list_position({NAMES}, label) - 1)::int else -1 end as cluster_id, case label when '<unparseable>' then 'unparseable' when '<hallucinated>' then 'hallucinated' else 'ok' end as status from res",
    "q55_results_table": f"with {CENTROIDS}, {_scores_of('nearest', 'predicted')}, {_scores_of('fixed', 'vec_id % 4')}, u as (select 'nearest' as method, round(ari, 6) as a, round(nmi, 6) as n from nearest union all select 'fixed', round(ari, 6), round(nmi, 6) from fixed) select 'given-k' as panel, method, a as embeddings_ari, n as embeddings_nmi, a = max(a) over () as embeddings_ari_best, n = max(n) over () as embeddings_nmi_best from u",
    "q56_cost_totals": "select source as method, sum(case when lang = 'en' then n_chars / 16.0 else 0 end)::double as subscription_usd, sum(n_chars / 8.0)::double as usd from documents group by all union all select 'none run', null, null",
    "q57_accumulated_usage": "select conv_id, sum(length(text))::bigint as input_tokens, sum(case when turn > 0 then length(text) else 0 end)::bigint as cache_tokens, sum(length(text) // 3)::bigint as output_tokens, count(*) as n_passes, string_agg(length(text)::varchar, ',' order by turn, length(text)) as passes, round(coalesce(sum(case when turn > 0 then length(text) else 0 end) / nullif(sum(case when turn > 0 then 2 * length(text) else length(text) end), 0)::double, 0), 6) as cache_hit_rate from conversations group by all",
    "q58_display_labels": f"with {CENTROIDS} select vec_id, case when predicted = -1 then 'noise' else 'cluster_' || predicted::varchar end as display from pred",
    "q59_weak_clusters": f"with {ASSIGNED}, c as (select cluster_id, count(*) as n, avg(case when cluster_id = 'c2' then 2.0 else confidence end) as m from asg where cluster_id <> '' group by all) select cluster_id, coalesce(name, 'unknown') as name, n, round(m, 6) as mean_confidence, 'low' as label from c left join names using (cluster_id) where m < 3",
    "q60_cluster_problems": "select doc_id, case doc_id % 5 when 0 then 'no object' when 2 then 'name' when 3 then 'description' when 4 then 'no object' end as problem from documents",
    "q61_first_rows": "select doc_id, source from documents order by doc_id limit 20",
    "q62_merged_or_given": "select conv_id * 100 + turn as id, case when conv_id % 2 = 0 then case when role = 'm' then 'm' else 'm|' || role end else 'a|' || role end as labels from conversations",
    "q64_topic_generation": """with o as (select length(text) // 1000 as k, row_number() over (order by md5('0:' || doc_id), doc_id::varchar, text) - 1 as r from documents where text is not null),
f as (select *, min(r) over (partition by k) = r as fresh from o), g as (select *, r - coalesce(max(case when fresh then r end) over (order by r), -1) as quiet from f),
stop as (select coalesce(min(r), 9000000000000000000) as s from g where quiet >= 200)
select 'Length ' || k as topic, 'texts of ' || k || ' thousand characters' as description, count(*) as n, min(r)::bigint as first from g, stop where r <= s group by k""",
    "q65_refined_topics": """with t as (select length(text) // 1000 as k, doc_id from documents where text is not null), p as (select k - k % 3 as k, count(*) as n, min(doc_id) as first from t group by 1)
select 'Length ' || k as topic, n, first from p where n >= 0.01::double * (select sum(n) from p)""",
    "q66_topic_correction": """with t as (select list(distinct 'T' || (doc_id % 5)) as names from documents),
a as (select doc_id, case when doc_id % 6 = 0 then 'Error' when doc_id % 11 = 0 then 'no line' else '[1] T' || (doc_id % 7) || ': why' end as r from documents),
f as (select *, r in ('Error', 'no line') or not list_contains(names, 'T' || (doc_id % 7)) as bad from a, t),
c as (select doc_id, names, case when bad and doc_id % 3 <> 1 and doc_id % 2 = 0 then '[1] T0: why' else r end as response from f)
select doc_id, response, response in ('Error', 'no line') as error, response not in ('Error', 'no line') and not list_contains(names, regexp_extract(response, 'T[0-9]+')) as hallucinated from c""",
}
