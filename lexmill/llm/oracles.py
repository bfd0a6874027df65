"""The same queries in SQL, written from the statements of the problems."""

VALID = """valid as (select lower(trim(term)) as term, doc_id, max(tf) as tf from postings
    where trim(term) <> '' and doc_id is not null and tf >= 1 group by 1, 2)"""

FREQUENCIES = f"""with {VALID}, counts as (select term, sum(tf)::bigint as occurrences, count(*) as records from valid group by term),
    marked as (select *, case when records = 1 then 'rare' when records * 3 > (select count(distinct doc_id) from valid) then 'common' end as mark from counts)"""

TOP = """with once as (select qid, doc_id, max(score) as score from bm25_scores
    where qid is not null and doc_id is not null and score is not null and not isnan(score) group by 1, 2),
    ranked as (select qid, row_number() over (partition by qid order by score desc, doc_id) as rank, doc_id, score from once)"""

DISTINCTIVE = f"""with {VALID}, dfs as (select term, count(*) as df from valid group by term),
    totals as (select doc_id, sum(tf)::bigint as doc_total from valid group by doc_id),
    recorded as (select doc_id, max(doc_len) as recorded from doc_stats group by doc_id),
    rows as (select v.doc_id, v.term, tf, df, doc_total, greatest(doc_total, coalesce(recorded, 0)) as doc_len
        from valid v join dfs using (term) join totals t on t.doc_id = v.doc_id left join recorded r on r.doc_id = v.doc_id)"""

FUSED = """with once as (select qid, doc_id, max(lex_score) as lex, max(sem_score) as sem from adaptive_scores
    where qid is not null and doc_id is not null group by 1, 2),
    lex as (select qid, doc_id from once where lex is not null qualify row_number() over (partition by qid order by lex desc, doc_id) <= 10),
    sem as (select qid, doc_id from once where sem is not null qualify row_number() over (partition by qid order by sem desc, doc_id) <= 10)"""

SIMILAR = """with clean as (select id, any_value(vec) as vec from term_vectors where id is not null and vec is not null and len(vec) = 100
        and len(list_filter(vec, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(vec, lambda x: x <> 0)) > 0 group by id),
    near as (select a.id as a, b.id as b, round(list_cosine_similarity(a.vec, b.vec), 6) as c from clean a join clean b on a.id <> b.id),
    top as (select a, b from near where c >= 0.9 qualify row_number() over (partition by a order by c desc, b) <= 10)"""

RUNS = """words as (select id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from texts where text is not null),
    runs as (select distinct id, array_to_string(list_slice(w, i, i + {n} - 1), ' ') as run from (select id, w, unnest(range(1, len(w) - {n} + 2)) as i from words where len(w) >= {n}))"""

EDITED = f"""with texts as (select distinct doc_id as id, text from collection_docs where doc_id is not null), {RUNS.format(n=3)},
    sizes as (select id, count(*) as n from runs group by id),
    shared as (select a.id as a, b.id as b, count(*) as s from runs a join runs b on a.run = b.run and a.id < b.id group by 1, 2)"""

LEAKED = f"""with texts as (select 2 * doc_id as id, text from documents union all select 2 * item_id + 1, text from eval_items), {RUNS.format(n=12)}"""

PASSAGES = """with items as (select item_id as item, unnest(w) as term, generate_subscripts(w, 1) - 1 as ipos from (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from eval_items where text is not null)),
    docs as (select doc_id as doc, unnest(w) as term, generate_subscripts(w, 1) - 1 as pos from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents where text is not null)),
    counts as (select term, count(*) as cf from docs group by term),
    windows as (select item, min({'cf': coalesce(cf, 0), 'term': i.term, 'ipos': ipos}) over w as best, count(*) over w as n from items i left join counts c on c.term = i.term
        window w as (partition by item order by ipos rows between current row and 11 following)),
    places as (select distinct item, best.term as term, best.ipos as ipos from windows where n = 12 and best.cf > 0),
    item_sides as (select item, ipos, string_agg(term, ' ') over l as l, count(*) over l as nl, string_agg(term, ' ') over r as r, count(*) over r as nr from items
        window l as (partition by item order by ipos rows between 5 preceding and 1 preceding), r as (partition by item order by ipos rows between 1 following and 6 following)),
    doc_sides as (select doc, term, pos, string_agg(term, ' ') over l as l, count(*) over l as nl, string_agg(term, ' ') over r as r, count(*) over r as nr from docs
        window l as (partition by doc order by pos rows between 5 preceding and 1 preceding), r as (partition by doc order by pos rows between 1 following and 6 following)),
    shifts as (select distinct d.doc, p.item, d.pos - p.ipos as shift from places p join item_sides i on i.item = p.item and i.ipos = p.ipos join doc_sides d on d.term = p.term
        and ((i.nl = 5 and d.nl = 5 and i.l = d.l) or (i.nr = 6 and d.nr = 6 and i.r = d.r))),
    met as (select s.doc, s.item, s.shift, i.ipos, bool_or(d.pos = s.shift + i.ipos) as exact from shifts s join items i on i.item = s.item
        join docs d on d.doc = s.doc and d.term = i.term and d.pos between s.shift + i.ipos - 2 and s.shift + i.ipos + 2 group by all),
    islands as (select doc, item, shift, ipos - row_number() over (partition by doc, item, shift order by ipos) as island from met where exact),
    runs as (select doc, item, max(n) as run_words from (select doc, item, count(*) as n from islands group by doc, item, shift, island) group by doc, item),
    dense as (select doc, item, max(n) as near_words from (select doc, item, count(*) over (partition by doc, item, shift order by ipos range between current row and 11 following) as n from met) group by doc, item)"""

#: The walk of the fused ranking, so many rounds that nothing moves any more.
WALK = """with recursive once as (select qid, doc_id, max(case when not isnan(lex_score) then lex_score end) as lex,
        max(case when not isnan(sem_score) then sem_score end) as sem from adaptive_scores where qid is not null and doc_id is not null group by 1, 2),
    ranked as (select qid, doc_id, count(*) over (partition by qid) as n,
        case when lex is not null then row_number() over (partition by qid order by lex desc nulls last, doc_id) end as rl,
        case when sem is not null then row_number() over (partition by qid order by sem desc nulls last, doc_id) end as rs from once),
    walk as (select 0 as t, *, 1.0::double / n as mass, (rl is not null)::int + (rs is not null)::int as lists from ranked
        union all
        select t + 1, qid, doc_id, n, rl, rs, held + (1 - sum(held) over (partition by qid)) / n, lists from (
            select *, 0.85::double * (coalesce(case when rl is not null then sum(mass / lists / rl) over (partition by qid order by rl desc nulls last rows unbounded preceding) end, 0)
                + coalesce(case when rs is not null then sum(mass / lists / rs) over (partition by qid order by rs desc nulls last rows unbounded preceding) end, 0)) as held
            from walk where t < 150)),
    rounded as (select *, round_even(mass * n * 1e12, 0) / 1e12 / n as m from walk where t = 150)"""

SQL = {
    "p2_found": f"{FREQUENCIES} select term, mark from marked where mark is not null",
    "p2_frequencies": f"{FREQUENCIES} select * from marked",
    "p3_found": f"{TOP} select qid, doc_id from ranked where rank <= 10",
    "p3_top": f"{TOP} select * from ranked where rank <= 10",
    "p6_found": f"{DISTINCTIVE} select doc_id, term from rows where df between 2 and 8 and tf * 5 >= doc_total",
    "p6_scores": f"""{DISTINCTIVE} select *, round(tf / doc_len * (ln((1 + (select count(*) from totals)) / (1 + df)) + 1), 6) as score from rows""",
    "p7_found": f"{FUSED} select qid, doc_id from lex join sem using (qid, doc_id)",
    "p7_ranking": f"""{WALK} select qid, doc_id, rl as rank_lex_score, rs as rank_sem_score, round(m, 9) as mass,
        row_number() over (partition by qid order by m desc, doc_id) as rank from rounded""",
    "p1_found": f"{SIMILAR} select x.a as id_a, x.b as id_b from top x join top y on x.a = y.b and x.b = y.a where x.a < x.b",
    "p1_nearest": f"""{SIMILAR.replace("b.vec), 6)", "b.vec), 9)")},
        ranked as (select a as id, b as neighbour, c as cosine, row_number() over (partition by a order by c desc, b) as rank from near where a % 20 = 0)
        select id, neighbour, cosine, rank from ranked where rank <= 10""",
    "p5_found": f"""{EDITED} select a as doc_id_a, b as doc_id_b from shared join sizes x on x.id = a join sizes y on y.id = b
        where s >= 0.6 * (x.n + y.n - s)""",
    "p5_groups": f"""{EDITED.replace("with texts", "with recursive texts")}, pairs as (select a, b from shared join sizes x on x.id = a join sizes y on y.id = b
            where s >= 0.6 * (x.n + y.n - s)),
        reach as (select id, id as other from sizes union
            select r.id, e.b from reach r join (select a, b from pairs union all select b, a from pairs) e on e.a = r.other)
        select id as doc_id, min(other) as group_id from reach group by id""",
    "p9_matches": f"""{PASSAGES} select doc as doc_id, item as item_id, run_words, near_words, case when run_words >= 12 then 'exact' else 'near' end as match
        from runs join dense using (doc, item) where run_words >= 12 or near_words >= 10""",
    "p9_found": f"""{LEAKED} select distinct d.id // 2 as doc_id, i.id // 2 as item_id from runs d join runs i on d.run = i.run and d.id % 2 = 0 and i.id % 2 = 1""",
}
