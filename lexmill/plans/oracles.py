"""The queries in SQL, written from the statements and formulas, not from the Spark plans."""

from lexmill.plans.oracles_retrieval import SQL as RETRIEVAL

SQL = {
    **RETRIEVAL,
    "p4_found": """with rows as (select lower(trim(term)) as term from postings where trim(term) <> '')
        select term from rows group by term having count(*) * 100 >= 3 * (select count(*) from rows)""",
    "p4_term_loads": """select lower(trim(term)) as term, count(*) as n_rows,
        count(*) filter (where doc_id is not null and tf >= 1) as n_valid,
        coalesce(sum(tf) filter (where doc_id is not null and tf >= 1), 0)::bigint as tf_total from postings where trim(term) <> '' group by 1""",
    "p4_block_check": """with meta as (select block, lower(trim(term)) as term, max(df) as df, max(ub) as ub from index_terms group by 1, 2),
        rows as (select lower(trim(term)) as term, block from postings where trim(term) <> '')
        select r.term, r.block, count(*) as n_rows, max(df) as recorded_df, round(max(ub), 6) as recorded_ub
        from rows r left join meta m on m.term = r.term and m.block = r.block group by 1, 2""",
}
