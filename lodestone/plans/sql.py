"""Named pieces of comparison SQL, put together as common table expressions."""

from __future__ import annotations

import re

BM25_K = DENSE_K = 150
RERANK_K = 80
SEED_K, FINAL_K, BUDGET = 2, 5, 1800
MIN_DF, MAX_DF_RATIO = 2, 0.03
SPACES = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
WHITESPACE = "' ' || chr(10) || chr(9) || chr(13)"


def cf(text: str) -> str:
    return f"replace(replace(lower({text}), 'ß', 'ss'), 'ς', 'σ')"


def tok(text: str) -> str:
    return f"regexp_extract_all({cf(text)}, '[\\p{{L}}\\p{{N}}_''-]+')"


def norm(text: str) -> str:
    return f"array_to_string({tok(text)}, ' ')"


ENTITY = (
    "(?:^|[^\\p{L}\\p{N}_])"
    "([A-Z](?:[\\p{L}\\p{N}_''-]+\\s+[A-Z]){0,3}[\\p{L}\\p{N}_''-]*[\\p{L}\\p{N}_])"
)


def entities(text: str) -> str:
    found = f"regexp_extract_all({text}, '{ENTITY}', 1)"
    named = f"list_transform({found}, lambda e: {norm('e')})"
    return f"list_sort(list_distinct(list_filter({named}, lambda e: length(e) > 2)))"


PUNCTUATION = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def answer(text: str) -> str:
    bare = f"translate(lower({text}), '{PUNCTUATION}', '')"
    for _ in range(2):
        bare = (f"regexp_replace({bare}, '(^|[^\\p{{L}}\\p{{N}}_])(?:a|an|the)($|[^\\p{{L}}\\p{{N}}_])', "
                f"'\\1 \\2', 'g')")
    return f"trim(regexp_replace({bare}, '{SPACES}', ' ', 'g'))"


def answer_toks(text: str) -> str:
    return f"list_filter(string_split({answer(text)}, ' '), lambda w: w <> '')"


def squeeze(text: str) -> str:
    return f"array_to_string(list_filter(regexp_split_to_array({cf(text)}, '{SPACES}'), lambda w: w <> ''), ' ')"


def stable_id(title: str, text: str) -> str:
    return f"'p_' || substr(sha1(({squeeze(title)} || chr(0) || {squeeze(text)})), 1, 16)"


def bucket(term: str, n: int = 256) -> str:
    return f"(('0x' || substr(md5({term}), 1, 8))::bigint % {n})"


def hit(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


PIECES: dict[str, str] = {
    "passages": """select doc_id as pid, doc_id as pos,
        case when instr(text, chr(10)) > 0 then substr(text, 1, instr(text, chr(10)) - 1) else text end as title,
        case when instr(text, chr(10)) > 0 then substr(text, instr(text, chr(10)) + 1) else '' end as body
        from documents""",
    "full_texts": f"select *, trim(title || '. ' || body, {WHITESPACE}) as ft from passages",
    "doc_tok": f"""select *, len(toks) as doc_len from (select pid, pos, {tok('ft')} as toks,
        greatest(1, ceil(length(ft) / 4.0))::bigint as est from full_texts)""",
    "q": f"""select *, [array_to_string(qtoks[-2:], ' ')] as answers from (
        select item_id as qid, text as question, {tok('text')} as qtoks from benchmark)""",
    "q_terms": "select qid, term, count(*) as qf from (select qid, unnest(qtoks) as term from q) group by all",
    "postings": """select pid, doc_len, term, count(*) as tf
        from (select pid, doc_len, unnest(toks) as term from doc_tok) group by all""",
    "idf": """select term, count(*) as df,
        ln(1 + ((select count(*) from doc_tok) - count(*) + 0.5) / (count(*) + 0.5)) as idf
        from postings group by term""",
    "bm25": """select qid, pid, sum(idf * qf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len
          / (select avg(doc_len) from doc_tok)))) as bm25_score
        from q_terms join postings using (term) join idf using (term) group by qid, pid""",
    "bm25_rank": f"""select * from (select qid, pid, pos, coalesce(bm25_score, 0) as bm25_score,
          row_number() over (partition by qid order by round(coalesce(bm25_score, 0), 9) desc, pos) as rank
        from q cross join doc_tok left join bm25 using (qid, pid)) where rank <= {BM25_K}""",
    "doc_cells": f"""select pid, {bucket('term')} as b, count(*)::double as w
        from (select pid, unnest(list_concat(['passage'], toks)) as term from doc_tok) group by all""",
    "q_cells": f"""select qid, {bucket('term')} as b, count(*)::double as w
        from (select qid, unnest(list_concat(['query'], qtoks)) as term from q) group by all""",
    "dense": """select qid, pid, dot / (dl * ql) as dense_score from (
          select qid, pid, sum(d.w * c.w) as dot from doc_cells d join q_cells c using (b) group by qid, pid)
        join (select pid, sqrt(sum(w * w)) as dl from doc_cells group by pid) using (pid)
        join (select qid, sqrt(sum(w * w)) as ql from q_cells group by qid) using (qid)""",
    "dense_rank": f"""select * from (select qid, pid, pos, coalesce(dense_score, 0) as dense_score,
          row_number() over (partition by qid order by round(coalesce(dense_score, 0), 9) desc, pos) as rank
        from q cross join doc_tok left join dense using (qid, pid)) where rank <= {DENSE_K}""",
    "fused": f"""select * from (select *, row_number() over (partition by qid order by round(rrf_score, 9) desc, pid) as rank
        from (select qid, pid, sum(1.0 / (60 + rank)) as rrf_score
          from (select qid, pid, rank from bm25_rank union all select qid, pid, rank from dense_rank)
          group by qid, pid)) where rank <= {RERANK_K}""",
    "fusion": """select qid, pid, rrf_score, rank, coalesce(bm25_score, 0) as bm25_score, coalesce(dense_score, 0) as dense_score
        from fused left join bm25 using (qid, pid) left join dense using (qid, pid)""",
    "lexical": """select f.*, len(list_intersect(qtoks, toks)) / greatest(1, len(list_distinct(qtoks))) as lexical
        from fusion f join doc_tok using (pid) join q using (qid)""",
    "ranking": """select qid, pid, row_number() over (partition by qid order by round(rerank_score, 9) desc, pid) as rank,
          bm25_score, dense_score, rrf_score, rerank_score from (
        select *, 0.5 * (case when rh > rl then (rrf_score - rl) / (rh - rl) else 0 end)
          + 0.3 * (case when dh > dl then (dense_score - dl) / (dh - dl) else 0 end) + 0.2 * lexical as rerank_score
        from (select *, min(rrf_score) over w as rl, max(rrf_score) over w as rh,
            min(dense_score) over w as dl, max(dense_score) over w as dh
          from lexical window w as (partition by qid)))""",
    "support": """select qid, pid from q join (select pid, ' ' || array_to_string(toks, ' ') || ' ' as body_norm from doc_tok) b
        on contains(body_norm, ' ' || array_to_string(qtoks, ' ') || ' ') where len(qtoks) > 0""",
    "support_sets": """select qid, coalesce(list_sort(list(pid) filter (pid is not null)), []) as support
        from q left join support using (qid) group by qid""",
    "ents": f"select pid, pos, {entities('ft')} as ents from full_texts",
    "ent_df": "select entity, count(*) as df from (select pid, unnest(ents) as entity from ents) group by entity",
    "allowed": f"""select * from ent_df where df >= {MIN_DF}
        and df <= (select greatest(2, ceil(count(*) * {MAX_DF_RATIO})) from ents)""",
    "mentions": """select pid, pos, entity, place, df, 1.0 / log2(2.0 + df) as confidence
        from (select pid, pos, unnest(ents) as entity, unnest(range(len(ents))) as place from ents)
        join allowed using (entity)""",
    "edges": """select 'p:' || pid as source, 'e:' || entity as target, 'mentions' as kind, confidence, pos as o_pos, 0 as o_kind, place as o_idx from mentions
        union all select 'e:' || entity, 'p:' || pid, 'mentions', confidence, pos, 0, place from mentions""",
    "degree": "select source as node, count(*) as degree from edges group by source",
    "seeds": f"select qid, pid, rank as seed_no from ranking where rank <= {SEED_K}",
    "seed_sets": "select qid, list(pid order by seed_no) as seed_ids from seeds group by qid",
    # hybrid context: greedy packing done item by item
    "queue": """select qid, pid, rank, est from ranking join doc_tok using (pid)""",
}


def compose(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the pieces it names, and those they name, in front of it."""
    pieces = {**PIECES, **(extra or {})}
    ordered: list[str] = []
    pending: set[str] = set()

    def need(text: str) -> None:
        for name in pieces:
            if name not in pending and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                pending.add(name)
                need(pieces[name])
                ordered.append(name)

    need(body)
    if not ordered:
        return body

    def listed(name: str) -> str:
        recursive = re.search(rf"\b(?:from|join)\s+{name}\b", pieces[name])
        return f"{name} as {'' if recursive else 'materialized '}({pieces[name]})"

    listing = ",\n".join(listed(name) for name in ordered)
    if body.lstrip().startswith("with recursive "):
        return "with recursive " + listing + ",\n" + body.lstrip()[len("with recursive "):]
    return f"with recursive {listing}\n{body}"
