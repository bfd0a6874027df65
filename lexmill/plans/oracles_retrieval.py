"""SQL of the retrieval queries: common table expressions for texts, stems and statistics, then one query each."""

# Fixed values, written here once more so that the SQL takes nothing from the code that it checks: the stop-word
# list, the suffix tables and their order.
STOPWORDS = tuple(
    """a an the and or but in on at to for of with by from is was are were be been being have has had do does did
    will would could should may might shall can this that these those it its as if not no nor so yet both either
    neither each few more most other some such than too very just about above after all also am any because before
    between during he her him his how i into me my our out own same she their them then there they through under
    until up us we what when where which while who whom why you your""".split()
)
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = (
    "ement", "ment", "ance", "ence", "able", "ible", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize",
    "al", "er", "ic",
)


def _suffix_case(rules, least):
    branches = " ".join(
        f"when ends_with(w, '{s}') then case when length(w) - {len(s)} >= {least} then left(w, length(w) - {len(s)}) || '{n}' else w end" for s, n in rules
    )
    return f"case {branches} else w end"


def _fixed(stem):
    """The repair after -ed and -ing."""
    return f"""case when regexp_matches({stem}, '(at|bl|iz)$') then {stem} || 'e'
        when length({stem}) > 1 and right({stem}, 1) = left(right({stem}, 2), 1) and right({stem}, 1) not in ('l', 's', 'z') then left({stem}, length({stem}) - 1)
        else {stem} end"""


STEP_SQL = [
    "case when ends_with(w, 'sses') or ends_with(w, 'ies') then left(w, length(w) - 2) when ends_with(w, 'ss') then w when ends_with(w, 's') then left(w, length(w) - 1) else w end",
    f"""case when ends_with(w, 'eed') then case when length(w) > 3 then left(w, length(w) - 1) else w end
        when ends_with(w, 'ed') then case when regexp_matches(left(w, length(w) - 2), '[aeiou]') then {_fixed("left(w, length(w) - 2)")} else w end
        when ends_with(w, 'ing') then case when regexp_matches(left(w, length(w) - 3), '[aeiou]') then {_fixed("left(w, length(w) - 3)")} else w end else w end""",
    "case when ends_with(w, 'y') and regexp_matches(left(w, length(w) - 1), '[aeiou]') then left(w, length(w) - 1) || 'i' else w end",
    _suffix_case(STEP2, 1),
    _suffix_case(STEP3, 1),
    _suffix_case([(s, "") for s in STEP4], 2),
    "case when ends_with(w, 'e') and length(w) > 1 then left(w, length(w) - 1) else w end",
    "case when ends_with(w, 'll') and length(w) > 2 then left(w, length(w) - 1) else w end",
]

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def base(corpus: str = "select doc_id, min(block) as block, min(text) as text from collection_docs where doc_id is not null group by doc_id") -> str:
    """docs, q, raw, stems, tokens, qtok, post, terms, lens, st"""
    steps = "vocab as (select distinct token, token as w from (select token from raw union all select token from qraw))"
    last = "vocab"
    for i, sql in enumerate(STEP_SQL):
        steps += f", s{i} as (select token, case when length(token) > 2 then {sql} else w end as w from {last})"
        last = f"s{i}"
    return f"""with docs as ({corpus}),
    q as (select qid, min(text) as text from queries where qid is not null and text is not null group by qid),
    raw as (select doc_id, block, unnest(t) as token, unnest(range(len(t))) as pos from (select doc_id, block, regexp_extract_all(lower(text), '[a-z]+') as t from docs)),
    qraw as (select qid, unnest(regexp_extract_all(lower(text), '[a-z]+')) as token from q),
    {steps}, stems as (select token, w as stem from {last}),
    tokens as (select doc_id, block, stem as term from raw join stems using (token) where length(token) > 1 and token not in ({STOP}) and length(stem) > 1),
    qall as (select qid, stem as term from qraw join stems using (token) where length(token) > 1 and token not in ({STOP}) and length(stem) > 1),
    qtok as (select qid, term, count(*) as qtf from qall group by qid, term),
    post as (select term, doc_id, count(*) as tf from tokens group by term, doc_id),
    terms as (select term, count(*) as df, sum(tf)::bigint as cf from post group by term),
    lens as (select doc_id, sum(tf)::bigint as doc_len from post group by doc_id),
    st as (select count(*) as n, avg(doc_len) as avgdl from lens)"""


def bm25(k=10, k1=1.2, b=0.75, qtf="qtf", name="run"):
    return f"""{name}_s as (select qid, p.doc_id, round(sum({qtf} * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * doc_len / avgdl))), 6) as score
        from qtok join post p using (term) join terms using (term) join lens l on l.doc_id = p.doc_id cross join st group by qid, p.doc_id),
    {name} as (select qid, row_number() over (partition by qid order by score desc, doc_id) as rank, doc_id, score from {name}_s qualify rank <= {k})"""


def tfidf(k=10, name="run"):
    return f"""{name}_s as (select qid, doc_id, round(sum(qtf * ln(n / df) * (1 + ln(tf))), 6) as score
        from qtok join post using (term) join terms using (term) cross join st group by qid, doc_id),
    {name} as (select qid, row_number() over (partition by qid order by score desc, doc_id) as rank, doc_id, score from {name}_s qualify rank <= {k})"""


PHRASE = "' ' || array_to_string(regexp_extract_all(lower({0}.text), '[a-z0-9]+'), ' ') || ' '"


def judged(run="run", name="judged"):
    return f"""{name} as (select qid, rank, r.doc_id, case when contains({PHRASE.format("d")}, {PHRASE.format("q")}) then 1 else 0 end::bigint as rel
        from {run} r join docs d on d.doc_id = r.doc_id join q using (qid))"""


def dcg(rank="rank"):
    return f"coalesce(sum(rel / log2({rank} + 1)) filter (where rel > 0), 0.0)"


def metrics(j="judged", name="m"):
    return f"""{name}_r as (select *, row_number() over (partition by qid order by rel desc, rank) as best,
        sum(rel) over (partition by qid order by rank) / rank as prec from {j}),
    {name} as (select qid, 0.2 * sum(rel * power(0.8, rank - 1)) as rbp, {dcg()} as dcg,
        case when sum(rel) > 0 then {dcg()} / {dcg("best")} else 0.0 end as ndcg,
        case when sum(rel) > 0 then sum(prec) filter (where rel = 1) / sum(rel) else 0.0 end as ap from {name}_r group by qid)"""


def report(method, m):
    cols = ", ".join(f"round(avg(coalesce({x}, 0.0)), 6) as mean_{x}" for x in ("rbp", "dcg", "ndcg", "ap"))
    return f"select '{method}' as method, {cols} from q left join {m} using (qid)"


BASE = base()
CHUNKS = "placed as (select *, (row_number() over (partition by term order by doc_id) - 1) // 4096 as chunk from post), gaps as (select term, chunk, doc_id, tf, doc_id - lag(doc_id, 1, 0) over (partition by term, chunk order by doc_id) as gap from placed)"
GAPS = "gaps as (select term, doc_id, tf, doc_id - lag(doc_id, 1, 0) over (partition by term order by doc_id) as gap from post)"
VBE = "array_to_string(list_transform(range(greatest(1, (length(bin({0})) + 6) // 7) - 1, -1, -1), lambda k: printf('%02X', (({0} >> (7 * k)::bigint) & 127) + case when k = 0 then 128 else 0 end)), '')"
RAW8 = "array_to_string(list_transform(range(8), lambda k: printf('%02X', ({0} >> (8 * k)::bigint) & 255)), '')"
GAMMA = "repeat('0', length(bin({0} + 1)) - 1) || bin({0} + 1)"


def _hexed(number):
    return f"""{BASE}, {CHUNKS} select term, chunk, string_agg({number.format("gap" if "length(bin" in number else "doc_id")}, '' order by doc_id) as postings_hex,
        string_agg({number.format("tf")}, '' order by doc_id) as tf_hex from gaps group by term, chunk"""


def _nibbles(bits):
    pad = f"rpad({bits}, ((length({bits}) + 7) // 8 * 8)::int, '0')"
    bit = lambda i: f"substr({pad}, (4 * k + {i})::int, 1)::int"
    return f"array_to_string(list_transform(range(length({pad}) // 4), lambda k: substr('0123456789ABCDEF', 1 + 8 * {bit(1)} + 4 * {bit(2)} + 2 * {bit(3)} + {bit(4)}, 1)), '')"


LISTS = f"""{BASE}, {CHUNKS} select term, chunk, count(*) as df, string_agg(doc_id::varchar, ',' order by doc_id) as ids,
    string_agg(tf::varchar, ',' order by doc_id) as tfs from placed group by term, chunk"""
ROUND = f"select term, chunk, ids, tfs from ({LISTS})"

FUSION = """with q as (select qid, min(text) as text from queries where qid is not null and text is not null group by qid),
    once as (select qid, doc_id, max(lex_score) as lex, max(sem_score) as sem from adaptive_scores where qid is not null and doc_id is not null group by 1, 2),
    l as (select qid, doc_id, lex from once where lex is not null qualify row_number() over (partition by qid order by lex desc, doc_id) <= 100),
    s as (select qid, doc_id, sem from once where sem is not null qualify row_number() over (partition by qid order by sem desc, doc_id) <= 100),
    cand as (select coalesce(l.qid, s.qid) as qid, coalesce(l.doc_id, s.doc_id) as doc_id, lex, sem from l full join s on l.qid = s.qid and l.doc_id = s.doc_id)"""

SNIPPET = f"""{BASE}, {bm25(5)},
    qs as (select qid, list(distinct term) as stems from qall group by qid),
    shown as (select qid, r.doc_id, stems, regexp_extract_all(text, '\\S+') as words from run r join qs using (qid) join docs d on d.doc_id = r.doc_id),
    hit as (select qid, doc_id, pos, len(words) as n, len(list_filter(stems, lambda x: contains(lower(words[pos + 1]), x))) > 0 as h
        from (select *, unnest(range(len(words))) as pos from shown)),
    win as (select qid, doc_id, n, pos, sum(h::int) over (partition by qid, doc_id order by pos rows between current row and 29 following)::bigint as n_hits from hit),
    best as (select qid, doc_id, pos as start, n_hits from win where pos <= greatest(n - 30, 0)
        qualify row_number() over (partition by qid, doc_id order by n_hits desc, pos) = 1)"""

SQL = {
    "tokens_raw": f"{BASE} select doc_id, pos, token from raw",
    "tokens_clean": f"{BASE} select doc_id, term from tokens",
    "vocab_stems": f"{BASE} select distinct r.token, stem from raw r join stems using (token)",
    "token_counts_by_lang": """select lang, count(*) as n_tokens, count(distinct token) as n_distinct from
        (select lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) as token from documents) group by lang""",
    "term_dictionary": f"{BASE} select row_number() over (order by term) - 1 as term_id, term from terms",
    "doc_dictionary": "select row_number() over (order by doc_name) - 1 as doc_key, doc_name from (select distinct doc_name from collection_docs where doc_id is not null and doc_name is not null)",
    "term_freq": f"{BASE} select * from post",
    "doc_freq": f"{BASE} select * from terms",
    "doc_length": f"{BASE} select * from lens",
    "corpus_stats": f"{BASE} select count(*) as n_docs, coalesce(sum(doc_len), 0)::bigint as n_tokens, round(avg(doc_len), 6) as avgdl from lens",
    "postings_lists": LISTS,
    "block_postings": f"{BASE} select block, term, doc_id, count(*) as tf from tokens group by all",
    "merged_postings": f"{BASE} select * from post",
    "idf_table": f"""{BASE} select term, df, cf, round(ln(n / df), 6) as idf_tfidf, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf_bm25,
        round(2.2 * ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as ub from terms cross join st""",
    "wand_bounds": f"{BASE} select term, round(2.6 * ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as ub from terms cross join st",
    "postings_gaps": f"{BASE}, {GAPS} select * from gaps",
    "gaps_decoded": f"{BASE} select * from post",
    "standard_hex": _hexed(RAW8),
    "vbe_hex": _hexed(VBE),
    "elias_hex": f"""{BASE}, {CHUNKS}, bits as (select term, chunk, count(*) as n, string_agg({GAMMA.format("gap")}, '' order by doc_id) as pb,
        string_agg({GAMMA.format("tf")}, '' order by doc_id) as tb from gaps group by term, chunk)
        select term, chunk, printf('%08X', n) || {_nibbles("pb")} as postings_hex, printf('%08X', n) || {_nibbles("tb")} as tf_hex from bits""",
    "standard_roundtrip": ROUND,
    "vbe_roundtrip": ROUND,
    "elias_roundtrip": ROUND,
    "codec_sizes": f"""{BASE}, {CHUNKS}, per as (select term, chunk, count(*) as n, sum((length(bin(gap)) + 6) // 7) as vp, sum((length(bin(tf)) + 6) // 7) as vt,
        ceil(sum(2 * length(bin(gap + 1)) - 1) / 8) + 4 as gp, ceil(sum(2 * length(bin(tf + 1)) - 1) / 8) + 4 as gt from gaps group by term, chunk)
        select 'standard' as codec, sum(n * 8)::bigint as postings_bytes, sum(n * 8)::bigint as tf_bytes from per
        union all select 'vbe', sum(vp)::bigint, sum(vt)::bigint from per union all select 'elias', sum(gp)::bigint, sum(gt)::bigint from per""",
    "prefix_lookup": f"{BASE} select term, df from terms where starts_with(term, 'brim')",
    "term_lookup": f"{BASE} select * from post where term in ('heart', 'rat', 'human')",
    "tree_nodes": f"""{BASE}, pre as (select distinct left(term, i) as p, i = length(term) as e, substr(term, (i + 1)::int, 1) as nx
            from (select term, unnest(range(1, length(term) + 1)) as i from terms)),
        node as (select p, bool_or(e) as e, count(distinct nx) filter (where nx <> '') as b from pre group by p)
        select count(*) as trie_nodes, count(*) filter (where e or b >= 2) as radix_nodes from node""",
    "membership_semi": f"{BASE} select qid, term, qtf from qtok where term in (select term from terms)",
    "unknown_terms_anti": f"{BASE} select qid, term, qtf from qtok where term not in (select term from terms)",
    "query_terms": f"{BASE} select qid, term, qtf from qtok",
    "tfidf_topk": f"{BASE}, {tfidf()} select * from run",
    "bm25_topk": f"{BASE}, {bm25()} select * from run",
    "bm25_dedup_topk": f"{BASE}, {bm25(qtf='1')} select * from run",
    "bm25_params": f"{BASE}, {bm25(20, 1.6, 0.5)} select * from run",
    "bm25_pruned_topk": f"{BASE}, {bm25(qtf='1')} select * from run",
    "documents_bm25": base("select doc_id, min(source) as block, min(text) as text from documents where doc_id is not null group by doc_id") + f", {bm25()} select * from run",
    "weight_matrix": f"{BASE} select term, doc_id, round((1 + ln(tf)) * ln(n / (df + 1)), 6) as weight from post join terms using (term) cross join st",
    "embedding_norms": "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as norm from embeddings",
    "embedding_ip_topk": """with u as (select vec_id, embedding::double[] as e from embeddings),
        s as (select a.vec_id, b.vec_id as neighbour, round(list_cosine_similarity(a.e, b.e), 6) as c from u a join u b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
        select vec_id, row_number() over (partition by vec_id order by c desc, neighbour) as rank, neighbour, c as score from s qualify rank <= 10""",
    "hybrid_fusion": base() .replace("with docs", FUSION.replace("with q as (select qid, min(text) as text from queries where qid is not null and text is not null group by qid),\n", "with ") + ", docs", 1) + """,
        b as (select *, min(lex) over w as ll, max(lex) over w as lh, min(sem) over w as sl, max(sem) over w as sh from cand window w as (partition by qid)),
        n as (select qid, count(*) as n from qall group by qid),
        f as (select b.qid, doc_id, case when coalesce(n, 0) <= 1 then 0.2 else 0.6 end as w,
            coalesce((coalesce(lex, ll) - ll) / greatest(lh - ll, 1e-5), 0) as l, coalesce((coalesce(sem, sl) - sl) / greatest(sh - sl, 1e-5), 0) as s from b left join n on n.qid = b.qid),
        g as (select qid, doc_id, round((1 - w) * l + w * s, 6) as score from f)
        select qid, row_number() over (partition by qid order by score desc, doc_id) as rank, doc_id, score from g qualify rank <= 10""",
    "hybrid_candidates": f"{FUSION} select qid, count(lex) as n_lexical, count(sem) as n_semantic, count(*) as n_union from cand group by qid",
    "snippet_window": f"{SNIPPET} select * from best",
    "snippet_text": f"""{SNIPPET}, pat as (select qid, '((?:' || array_to_string(list_transform(list_sort(list_transform(stems, lambda x: printf('%04d', 9999 - length(x)) || x)), lambda y: substr(y, 5)), '|') || ')[a-z]*)' as p from qs),
        made as (select b.qid, b.doc_id, '... ' || regexp_replace(array_to_string(list_slice(words, start + 1, start + 30), ' '), p, '**\\1**', 'gi') || ' ...' as snippet
            from best b join shown s on s.qid = b.qid and s.doc_id = b.doc_id join pat on pat.qid = b.qid)
        select r.qid, r.doc_id, coalesce(snippet, '') as snippet from run r left join made m on m.qid = r.qid and m.doc_id = r.doc_id""",
    "qrels_join": f"{BASE}, {bm25(100)}, {judged()} select * from judged",
    "metric_rbp": f"{BASE}, {bm25(100)}, {judged()}, {metrics()} select qid, round(rbp, 6) as rbp from m",
    "metric_dcg": f"{BASE}, {bm25(100)}, {judged()}, {metrics()} select qid, round(dcg, 6) as dcg from m",
    "metric_dcg_at_p": f"{BASE}, {bm25(100)}, {judged()} select qid, round({dcg()}, 6) as dcg from judged where rank <= 5 group by qid",
    "metric_ndcg": f"{BASE}, {bm25(100)}, {judged()}, {metrics()} select qid, round(ndcg, 6) as ndcg from m",
    "metric_ndcg_at_p": f"{BASE}, {bm25(5)}, {judged()}, {metrics()} select qid, round(ndcg, 6) as ndcg from m",
    "metric_ap": f"{BASE}, {bm25(100)}, {judged()}, {metrics()} select qid, round(ap, 6) as ap from m",
    "eval_report": f"""{BASE}, {tfidf(100, "t")}, {bm25(100, name="b")}, {bm25(100, qtf="1", name="w")}, {judged("t", "tj")}, {judged("b", "bj")}, {judged("w", "wj")},
        {metrics("tj", "tm")}, {metrics("bj", "bm")}, {metrics("wj", "wm")} {report("tfidf", "tm")} union all {report("bm25", "bm")} union all {report("wand", "wm")}""",
    "stream_index_blocks": f"{BASE} select * from post",
    "pruning_stats": f"""{BASE}, idfs as (select term, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf from terms cross join st),
        asked as (select qid, term, idf, 2.2 * idf as ub from qtok join idfs using (term)),
        gains as (select term, p.doc_id, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avgdl)) as gain from post p join idfs using (term) join lens l on l.doc_id = p.doc_id cross join st
            where term in (select term from asked)),
        kth as (select term, gain from gains qualify row_number() over (partition by term order by gain desc) = 10),
        marked as (select qid, a.term, sum(ub) over (partition by qid order by ub, a.term rows unbounded preceding) >= coalesce(max(gain) over (partition by qid), 0) - 1e-5 as essential
            from asked a left join kth on kth.term = a.term),
        met as (select qid, doc_id, bool_or(essential) as kept from gains join marked using (term) group by qid, doc_id)
        select qid, count(*) as met, count(*) filter (where kept) as kept from met group by qid""",
    "saved_postings": f"{BASE} select * from post",
    "saved_lookup": f"{BASE} select * from post where term in ('heart', 'rat', 'human')",
    "saved_terms": f"""{BASE} select row_number() over (order by term) - 1 as term_id, term, df, cf, round(2.2 * ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as ub from terms cross join st""",
    "saved_documents": f"""{BASE} select doc_id, doc_name, doc_len from lens join (select doc_id, min(doc_name) as doc_name from collection_docs group by doc_id) using (doc_id)""",
    "legacy_metadata": """with once as (select block, term, max(df) as df, max(ub) as ub from index_terms where block is not null and term is not null group by 1, 2),
        per as (select term, sum(df)::bigint as df, max(ub) as ub, count(*) filter (where ub is null) as old from once group by term),
        n as (select count(distinct doc_id) as n from doc_stats)
        select term, df, round(case when old > 0 then 2.2 * ln(1 + (n - df + 0.5) / (df + 0.5)) else ub end, 6) as ub from per cross join n""",
    "document_numbers": r"""select distinct doc_name, nullif(regexp_extract(doc_name, '[\\/](\d+)\.txt$', 1), '')::bigint as number from collection_docs where doc_name is not null""",
    "result_lines": f"""{BASE}, {bm25(5)}, names as (select doc_id, min(doc_name) as doc_name from collection_docs group by doc_id)
        select qid, rank, '  ' || rpad(doc_name, greatest(45, length(doc_name))::int, ' ') || ' ' || lpad((score::decimal(18, 6))::decimal(18, 4)::varchar, 8, ' ') as line from run join names using (doc_id)""",
    "query_file_rows": r"""select qid, array_to_string(regexp_extract_all(min(text), '\S+'), ' ') as text from queries where qid is not null and text is not null group by qid""",
    "qrels_file_rows": f"{BASE}, {bm25(100)}, {judged()} select qid, doc_id, 1 as rel from judged where rel = 1",
    "eval_timed": "select unnest(['tfidf', 'bm25', 'wand']) as method, true as timed",
    "metric_ap_full": f"""{BASE}, {bm25(20)}, {judged()}, rels as (select qid, doc_id from q cross join docs d where contains({PHRASE.format("d")}, {PHRASE.format("q")})),
        r as (select qid, count(*) as n from rels group by qid), p as (select *, sum(rel) over (partition by qid order by rank) / rank as prec from judged)
        select p.qid, round(coalesce(sum(prec) filter (where rel = 1) / any_value(n), 0.0), 6) as ap_full from p left join r on r.qid = p.qid group by p.qid""",
    "metric_ndcg_full": f"""{BASE}, {bm25(20)}, {judged()}, rels as (select qid, doc_id from q cross join docs d where contains({PHRASE.format("d")}, {PHRASE.format("q")})),
        ideal as (select qid, sum(1 / log2(b + 1)) as i from (select qid, row_number() over (partition by qid order by doc_id) as b from rels) group by qid)
        select j.qid, round(coalesce({dcg()} / any_value(i), 0.0), 6) as ndcg_full from judged j left join ideal on ideal.qid = j.qid group by j.qid""",
    "lsi_check": f"""{BASE} select least(100, (select count(*) from terms) - 1, (select count(*) from lens) - 1) as n_sigma, true as falling, true as documents_at_unit_length,
        true as terms_orthogonal, true as factors_agree""",
    "lsi_query_norms": f"""{BASE} select q.qid, case when count(t.term) > 0 then 1.0 else 0.0 end as norm from q left join qtok on qtok.qid = q.qid left join terms t on t.term = qtok.term group by q.qid""",
    "lsi_hits": f"""{BASE} select qid, least(10, (select count(*) from lens)) as n_hits, true as known_documents, true as ordered from q""",
    "hybrid_hits": f"""{BASE} select qid, least(10, (select count(*) from lens)) as n_hits, true as known_documents, true as ordered from q""",
}

#: Depth of the evaluation.
DEPTH = 1000
SQL |= {
    f"qrels_join_1000": f"{BASE}, {bm25(DEPTH)}, {judged()} select * from judged",
    f"metric_rbp_1000": f"{BASE}, {bm25(DEPTH)}, {judged()}, {metrics()} select qid, round(rbp, 6) as rbp from m",
    f"metric_dcg_1000": f"{BASE}, {bm25(DEPTH)}, {judged()}, {metrics()} select qid, round(dcg, 6) as dcg from m",
    f"metric_ndcg_1000": f"{BASE}, {bm25(DEPTH)}, {judged()}, {metrics()} select qid, round(ndcg, 6) as ndcg from m",
    f"metric_ap_1000": f"{BASE}, {bm25(DEPTH)}, {judged()}, {metrics()} select qid, round(ap, 6) as ap from m",
    f"eval_lexical_1000": f"""{BASE}, {tfidf(DEPTH, "t")}, {bm25(DEPTH, name="b")}, {bm25(DEPTH, qtf="1", name="w")}, {judged("t", "tj")}, {judged("b", "bj")}, {judged("w", "wj")},
        {metrics("tj", "tm")}, {metrics("bj", "bm")}, {metrics("wj", "wm")} {report("tfidf", "tm")} union all {report("bm25", "bm")} union all {report("wand", "wm")}""",
}
