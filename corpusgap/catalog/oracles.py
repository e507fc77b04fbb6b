"""SQL for DuckDB that computes the queries a second, independent way."""

from __future__ import annotations

from corpusgap.catalog.derive import SCORE_RULES
from corpusgap.functions import fixed_values as fixed


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


STOP = ", ".join(quote(w) for w in fixed.ENGLISH_STOP_WORDS)
NO_TERM = ", ".join(quote(w) for w in [*fixed.ENGLISH_STOP_WORDS, *fixed.SPECIAL_TOKENS])
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')"
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
EPS = "2.220446049250313e-16::double"
GROUP = "domain, split"

CORPUS = """corpus as (
  select source as domain,
         case when (doc_id // 20) % 5 = 0 then 'test' else 'train' end as split,
         doc_id, lang, text
  from documents)"""

PAIR_TEXT = CORPUS + """,
pair_text as (
  select c.domain, c.split, c.doc_id, c.text,
         case when c.doc_id % 17 = 0 then null
              when c.doc_id % 17 = 1 then substr(c.text, 1, 40)
              else b.text end as summary
  from corpus c left join benchmark b
    on b.item_id = c.doc_id % (select count(*) from benchmark))"""

ADMISSIBLE = PAIR_TEXT + """,
admissible as (
  select * from pair_text
  where text is not null and summary is not null
    and 2 * length(summary) < length(text) and length(text) < 1000 * length(summary)
    and not contains(text, summary))"""

TERMS = CORPUS + f""",
tokens as (select {GROUP}, doc_id, unnest({TOKENS}) as term from corpus),
terms as (select {GROUP}, term, count(*) as n from tokens
          where term not in ({NO_TERM}) group by all),
totals as (select {GROUP}, sum(n) as word_count, count(*) as vocab_size from terms group by all),
probs as (select {GROUP}, term, n, n / word_count as p from terms join totals using ({GROUP}))"""

TFIDF = CORPUS + f""",
doc_words as (select {GROUP}, doc_id, unnest({WORDS}) as term from corpus),
tf as (select {GROUP}, doc_id, term, count(*) as tf from doc_words
       where term not in ({STOP}) group by all),
df as (select {GROUP}, term, count(*) as df from tf group by all),
sizes as (select {GROUP}, count(*) as docs from corpus group by all),
raw as (select tf.*, tf.tf * (ln((1 + docs) / (1 + df)) + 1) as w
        from tf join df using ({GROUP}, term) join sizes using ({GROUP})),
norms as (select {GROUP}, doc_id, sqrt(sum(w * w)) as norm from raw group by all),
weights as (select {GROUP}, doc_id, term, tf, w / norm as weight
            from raw join norms using ({GROUP}, doc_id)),
ranked as (select {GROUP}, term, score,
             row_number() over (partition by {GROUP} order by round(score, 9) desc, term desc) as rank
           from (select {GROUP}, term, sum(weight) as score from weights group by all))"""

SCORES = (
    "scores as (\n  select ds, split, case when t = 1 then 'tuned' else 'base' end as model,\n    "
    + ",\n    ".join(
        f'(sum((x * {a} + t * {b}) % {m} + {base}) / count(*)) / {unit}::double as "{name}"'
        for name, a, b, m, base, unit in SCORE_RULES
    )
    + """
  from (select source as ds,
               case when (doc_id // 20) % 5 = 0 then 'test' else 'train' end as split,
               n_chars + length(source) * 7 + doc_id % 20 as x, unnest([0, 1]) as t
        from documents)
  where not (t = 1 and (split = 'train' or ds = 'src7'))
  group by ds, split, t)"""
)

PAIRS = """domains as (select distinct source as domain from documents),
pairs as (
  select 'in-domain-adapt' as da_type, domain as source, domain as target from domains
  union all select 'no-domain-adapt', domain, domain from domains
  union all select 'single-domain-adapt', a.domain, b.domain
  from domains a, domains b where a.domain <> b.domain),
resolved as (
  select *, case when da_type = 'single-domain-adapt' then 'test' else 'train' end as source_split,
         case when da_type = 'no-domain-adapt' then 'train' else 'test' end as target_split
  from pairs)"""

PARSE = CORPUS + rf""",
sentences as (
  select domain, split, doc_id, unnest(parts) as sentence,
         generate_subscripts(parts, 1) - 1 as sent_id
  from (select *, regexp_split_to_array(text, '[.!?]+') as parts from corpus)),
words as (
  select domain, split, doc_id, sent_id, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as i
  from (select *, regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]') as ws
        from sentences)),
parse as (
  select domain, split, doc_id, sent_id::int as sent_id, i::int as i,
         (i // (2 + length(word) % 3))::int as head from words)"""

DEPTHS = """,
climb(domain, split, doc_id, sent_id, i, depth) as (
  select domain, split, doc_id, sent_id, i, 1 from parse where i = head
  union all
  select p.domain, p.split, p.doc_id, p.sent_id, p.i, c.depth + 1
  from climb c join parse p on p.domain = c.domain and p.split = c.split and p.doc_id = c.doc_id
    and p.sent_id = c.sent_id and p.head = c.i and p.i <> p.head)"""


def union_distribution(probs: str = "probs", pairs: str = "resolved") -> str:
    """Both distributions of every pair over the union of their terms, filled with EPS."""
    return f"""listed as (select distinct source, source_split, target, target_split from {pairs}),
filled as (
  select source, source_split, target, target_split, term,
         coalesce(max(p), {EPS}) as p, coalesce(max(q), {EPS}) as q,
         max(p) is not null and max(q) is not null as shared, max(q) is not null as in_target
  from (
    select l.*, b.term, b.p as p, null::double as q from listed l
      join {probs} b on b.domain = l.source and b.split = l.source_split
    union all
    select l.*, b.term, null::double, b.p from listed l
      join {probs} b on b.domain = l.target and b.split = l.target_split)
  group by source, source_split, target, target_split, term),
masses as (
  select source, source_split, target, target_split, sum(p) as zp, sum(q) as zq
  from filled group by all),
divergences as (
  select source, source_split, target, target_split,
         100.0 * count(*) filter (shared) / count(*) filter (in_target) as overlap,
         sum(p * ln(p / q) - p + q) as kl,
         sqrt(greatest(0, sum(
           p / zp * ln(2 * (p / zp) / (p / zp + q / zq))
           + q / zq * ln(2 * (q / zq) / (p / zp + q / zq))) / 2)) as js
  from filled join masses using (source, source_split, target, target_split) group by all)"""


ENTROPY = "entropies as (select domain, split, -sum(p * ln(p)) as h from probs group by all)"


def overlap_of(table: str, pairs: str = "listed") -> str:
    """100 * shared / target size for every pair, from a (domain, split, term) table."""
    return f"""select l.source, l.source_split, l.target, l.target_split,
       100.0 * count(s.term) / count(t.term) as overlap
from {pairs} l join {table} t on t.domain = l.target and t.split = l.target_split
left join {table} s on s.domain = l.source and s.split = l.source_split and s.term = t.term
group by all"""


LISTED = "listed as (select distinct source, source_split, target, target_split from resolved)"
PAIR = "source, source_split, target, target_split"


def contextual_of(vectors: str, pairs: str) -> str:
    """Mean cosine by the full matrix of document pairs after the cut."""
    return f"""vec_ranked as (
  select domain, split, embedding,
         row_number() over (partition by domain, split order by doc_id) as rn,
         count(*) over (partition by domain, split) as size from {vectors}),
cosines as (
  select l.source, l.source_split, l.target, l.target_split,
         avg(list_cosine_similarity(a.embedding::double[], b.embedding::double[])) as cosine
  from {pairs} l
  join vec_ranked a on a.domain = l.source and a.split = l.source_split
  join vec_ranked b on b.domain = l.target and b.split = l.target_split
  where a.rn <= b.size and b.rn <= a.size group by all)"""


VECTORS = """vectors as (
  select domain, split, doc_id, embedding from corpus join embeddings on vec_id = doc_id)"""

WEIGHTS = (fixed.DEPENDENCY_LENGTH_WEIGHT, fixed.TREE_DEPTH_WEIGHT)

DIFFICULTY = f"""lengths as (select domain, split, avg(abs(i - head)) as len from parse group by all),
tops as (select domain, split, max(depth) as depth from climb group by all),
difficulty as (
  select domain, split, len, depth, {WEIGHTS[0]} * len + {WEIGHTS[1]} * depth as difficult
  from lengths join tops using (domain, split))"""

BUCKET = "cast('0x' || substr(md5(cast({key} as varchar)), 1, 8) as bigint) % {n}"


def bucket(key: str, n: int) -> str:
    return BUCKET.format(key=key, n=n)


INSTRUCTION = " || chr(10)".join(quote(p) for p in fixed.INSTRUCTION.split("\n")[:1])

TEXT_SQL = {
    # the table is one file in the order of its ids
    "corpus_without_ids": "select doc_id, source, md5(text) as text_md5 from documents",
    "corpus_scan": """
select 'documents' as domain, case when (doc_id // 20) % 5 = 0 then 'test' else 'train' end as split,
       doc_id, text, summary
from (select *, 'In short: ' || regexp_extract(text, '^[^.!?]*') as summary from documents)
where 2 * length(summary) < length(text) and length(text) < 1000 * length(summary)
  and not contains(text, summary) and length(text) >= 200""",
    "split_scan": f"with {CORPUS} select * from corpus where split = 'test'",
    "csv_roundtrip": f"with {CORPUS} select doc_id, domain, text, split from corpus",
    "score_scan": f"with {SCORES} select ds, split, model, "
    + ", ".join(f'round("{m}", 6) as "{m}"' for m in fixed.METRICS) + " from scores",
    "ingest_admissible": f"with {ADMISSIBLE} select * from admissible where length(text) >= 200",
    "combine_columns": """
select doc_id, concat_ws(' ' || chr(10) || ' ', lang, quality::varchar, source) as summary
from documents left join labels using (doc_id)""",
    "combine_list_field": """
select doc_id, array_to_string(string_split(text, chr(10)), ' ') as sources from documents""",
    "instruction_prompt": f"select doc_id, {INSTRUCTION} || chr(10) || text as text from documents",
    "embed_truncate": r"""
select doc_id, case when words > 4000 then substr(text, 1, 4000) else text end as embed_text,
       words
from (select *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::int as words
      from documents)""",
    "chunk_text": f"""
with {CORPUS}, stripped as (
  select domain, split, doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t
  from corpus),
pieces as (select *, unnest(range(0, length(t), 5000)) as start from stripped where t <> '')
select domain, split, doc_id, (start // 5000)::int as chunk_no, substr(t, start + 1, 5000) as chunk
from pieces""",
    "preview_per_split": f"""
with {CORPUS} select * from corpus
qualify row_number() over (partition by {GROUP} order by doc_id) <= 4""",
    "train_cap": f"""
with {CORPUS} select * from corpus
qualify split <> 'train' or row_number() over (partition by {GROUP} order by doc_id) <= 25""",
    "profile_cap": f"""
with {ADMISSIBLE} select domain, split, doc_id, summary from admissible
qualify row_number() over (partition by {GROUP} order by doc_id) <= 5""",
    "holdout_split": f"select doc_id, {bucket('doc_id', 100)} < 33 as is_test from documents",
    "kfold_assign": f"select doc_id, ({bucket('doc_id', 3)})::int as fold from documents",
    "ft_export": f"""
with {ADMISSIBLE}
select domain, case when {bucket('doc_id', 100)} < 10 then 'validation' else 'train' end as split,
       doc_id, {INSTRUCTION} || chr(10) || text as text, summary
from admissible where split = 'train'""",
    "tokenize": f"""
with {CORPUS} select domain, term, count(*) as n
from (select domain, unnest({TOKENS}) as term from corpus) group by all""",
    "token_filter": f"""
with {CORPUS} select doc_id, count(*) as tokens, count(*) filter (term not in ({NO_TERM})) as kept
from (select doc_id, unnest({TOKENS}) as term from corpus) group by all""",
    "term_frequency": f"with {TERMS} select {GROUP}, term, n from terms",
    "term_probability": f"with {TERMS} select {GROUP}, term, n, round(p, 9) as p from probs",
    "shannon_entropy": f"""
with {TERMS} select {GROUP}, round(-sum(p * ln(p)), 6) as shannon_entropy from probs group by all""",
    "domain_profile": f"""
with {TERMS},
sizes as (select {GROUP}, count(*) as dataset_size from corpus group by all),
h as (select {GROUP}, -sum(p * ln(p)) as h from probs group by all)
select {GROUP}, dataset_size, coalesce(word_count, 0)::bigint as word_count,
       coalesce(vocab_size, 0) as vocab_size, round(coalesce(h, 0), 6) as shannon_entropy,
       'Dataset: ' || domain || ' (' || split || '), documents: ' || dataset_size
         || ', words: ' || coalesce(word_count, 0)::bigint as summary
from sizes left join totals using ({GROUP}) left join h using ({GROUP})""",
    "dependency_length": f"""
with {PARSE} select {GROUP}, round(avg(abs(i - head)), 6) as avg_dependency_length
from parse group by all""",
    "tree_depth": f"""
with recursive {PARSE}{DEPTHS}
select {GROUP}, doc_id, sent_id, count(*)::int as tokens, true as is_tree,
       max(depth)::int as tree_depth from climb group by all""",
    "learning_difficulty": f"""
with recursive {PARSE}{DEPTHS}, {DIFFICULTY},
counts as (
  select domain, split, count(*) as sentences,
         cast(sum(case when coalesce(reached, 0) < tokens then 1 else 0 end) as bigint) as broken_sentences
  from (select domain, split, doc_id, sent_id, count(*) as tokens from parse group by all)
  left join (select domain, split, doc_id, sent_id, count(*) as reached from climb group by all)
    using (domain, split, doc_id, sent_id)
  group by domain, split)
select {GROUP}, round(len, 6) as avg_dependency_length, depth::int as max_tree_depth,
       sentences, broken_sentences,
       round(difficult, 6) as learning_difficult from difficulty join counts using (domain, split)""",
    "tfidf_weights": f"""
with {TFIDF} select {GROUP}, doc_id, term, tf, round(weight, 6) as weight from weights""",
    "tfidf_top_terms": f"""
with {TFIDF} select {GROUP}, term, round(score, 6) as score, rank::int as rank
from ranked where rank <= 10000""",
    "tfidf_overlap": f"""
with {TFIDF}, {PAIRS}, {LISTED}, top as (select * from ranked where rank <= 300),
shares as ({overlap_of("top")})
select {PAIR}, round(overlap, 6) as "tf-idf-overlap" from shares""",
    "vocab_overlap": f"""
with {TERMS}, {PAIRS}, {LISTED}, shares as ({overlap_of("terms")})
select {PAIR}, round(overlap, 6) as "vocab-overlap" from shares""",
    "global_distribution": f"""
with {TERMS}, {PAIRS}, {union_distribution()}
select {PAIR}, count(*) as terms, count(*) filter (p = {EPS}) as p_filled,
       count(*) filter (q = {EPS}) as q_filled, round(sum(p), 6) as p_mass,
       round(sum(q), 6) as q_mass, round(max(p), 6) as p_max, round(max(q), 6) as q_max
from filled group by all""",
    "kl_divergence": f"""
with {TERMS}, {PAIRS}, {union_distribution()}
select {PAIR}, round(kl, 6) as "kl-divergence" from divergences""",
    "js_distance": f"""
with {TERMS}, {PAIRS}, {union_distribution()}
select {PAIR}, round(js, 6) as "js-divergence" from divergences""",
    "language_distances": f"""
with {TERMS.replace("source as domain", "lang as domain").replace(
        "case when (doc_id // 20) % 5 = 0 then 'test' else 'train' end", "'test'")},
resolved as (
  select a.domain as source, 'test' as source_split, b.domain as target, 'test' as target_split
  from totals a, totals b where a.domain <> b.domain),
{ENTROPY}, {union_distribution()}
select source, target, round(overlap, 6) as "vocab-overlap",
       round(s.h, 6) as source_shannon_entropy, round(t.h, 6) as target_shannon_entropy,
       round(kl, 6) as "kl-divergence", round(js, 6) as "js-divergence"
from divergences d join entropies s on s.domain = d.source join entropies t on t.domain = d.target""",
    "contextual_overlap": f"""
with vectors as (
  select 'label' || label as domain, 'test' as split, vec_id as doc_id, embedding from embeddings),
names as (select distinct domain from vectors),
listed as (select a.domain as source, 'test' as source_split, b.domain as target,
                  'test' as target_split from names a, names b where a.domain <> b.domain),
{contextual_of("vectors", "listed")}
select {PAIR}, round(cosine, 6) as "contextual-overlap" from cosines""",
}

DISTANCES_CTE = f"""{PAIRS}, {union_distribution()}, {ENTROPY}, top as (select * from ranked where rank <= 10000),
top_shares as ({overlap_of("top")}),
{VECTORS}, {contextual_of("vectors", "listed")},
distances as (
  select d.source, d.source_split, d.target, d.target_split, d.overlap as "vocab-overlap",
         o.overlap as "tf-idf-overlap", s.h as source_shannon_entropy, t.h as target_shannon_entropy,
         d.kl as "kl-divergence", d.js as "js-divergence", c.cosine as "contextual-overlap"
  from divergences d
  left join entropies s on s.domain = d.source and s.split = d.source_split
  left join entropies t on t.domain = d.target and t.split = d.target_split
  left join top_shares o using ({PAIR}) left join cosines c using ({PAIR}))"""

TERMS_AND_TFIDF = TERMS + TFIDF.removeprefix(CORPUS)

TEXT_SQL["pair_distances"] = (
    f"with {TERMS_AND_TFIDF}, {DISTANCES_CTE} select {PAIR}, "
    + ", ".join(f'round("{d}", 6) as "{d}"' for d in fixed.DISTANCES)
    + " from distances"
)
