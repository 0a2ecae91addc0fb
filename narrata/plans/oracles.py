"""DuckDB SQL equivalent to the registered queries.

Written against the driver's tables, independently of the DataFrame code. A
query that SQL cannot express (text vectors, components of a reduction) has none and is
compared with brute force in the tests. Clusters are compared for vectors reduced to as many components as they have: that
keeps all distances, so SQL can start from the standardised vectors.
"""

from __future__ import annotations

import re

from narrata.functions.stopwords import ENGLISH_STOP_WORDS
from narrata.operators import tags

_LISTED_COMMUNITIES = "('politics', 'conspiracy', 'worldnews', 'Conservative')"
_STOP = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS) + ")"

_SPACES = r"\t\n\f\r \x0b\x1c-\x1f\x{85}\p{Z}"
_WORD = r"[\p{L}\p{N}_]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g')"


def _clean(x: str) -> str:
    out = f"lower(coalesce({x}, ''))"
    for pattern, by in (
        (f"http[^{_SPACES}]+|www[^{_SPACES}]+", ""),
        (r"\[[^\n]*?\]\([^\n]*?\)", ""),
        (r"[`*\[\]()]", ""),
        (r"\n+", "\n"),
        (f"r/{_WORD}+", ""),
        (f"u/{_WORD}+", ""),
        (f"[{_SPACES}]{{2,}}", " "),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return _strip(out)


_POSTS = r"""
posts as (
  select cast(d.doc_id as varchar) as post_id,
    case d.source when 'src0' then 'politics' when 'src1' then 'conspiracy' when 'src2' then 'worldnews'
                  when 'src3' then 'Conservative' else d.source end as subreddit,
    case when e.user_id % 30 = 0 then '[deleted]' else concat('user_', cast(e.user_id % 30 as varchar)) end as author,
    split_part(d.text, chr(10), 1) as title,
    case when strpos(d.text, chr(10)) = 0 then '' else substr(d.text, strpos(d.text, chr(10)) + 1) end as selftext,
    cast(floor(e.value * 4) as int) as score,
    cast(json_extract_string(e.props, '$.k') as int) * 4 as num_comments,
    case when v.label = 3 then timestamp '2024-01-05 12:00:00' + (cast(minute(e.ts) as int) * interval '1' minute)
         else e.ts end as created_utc,
    case d.lang when 'fr' then 'Satire' when 'de' then 'Liberal view' else null end as flair,
    p.url as url, d.doc_id as seq, v.label - 1 as cluster_label
  from documents d join events e on e.event_id = d.doc_id
  left join pages p on p.page_id = d.doc_id
  left join embeddings v on v.vec_id = d.doc_id
)"""

_COMMENTS = """
comments as (
  select c.conv_id || '-' || c.turn as comment_id, cast(c.conv_id as varchar) as post_id, c.role as author,
    c.text as raw_body, cast((c.conv_id * 7 + c.turn * 13) % 101 - 5 as int) as score, e.ts as created_utc,
    case when c.turn = 0 then 't3_' || c.conv_id else 't1_' || c.conv_id || '-' || (c.turn - 1) end as parent_id,
    cast(c.turn as int) as comment_seq
  from conversations c join events e on e.event_id = c.conv_id * 8 + c.turn
)"""

_IN_CLUSTER = "cluster_label is not null and cluster_label <> -1"


def _listed(communities: bool, top_limit: int | None, hot_limit: int | None, as_of: bool) -> str:
    """CTE ``listed``: both listings with their order key."""
    where = f"subreddit in {_LISTED_COMMUNITIES}" if communities else "true"
    month = "created_utc between timestamp '2024-02-02 00:00:00' - interval '1' month and timestamp '2024-02-02 00:00:00'"
    since = month if as_of else "true"
    position = (
        "case subreddit when 'politics' then 1 when 'conspiracy' then 2 when 'worldnews' then 3 else 4 end"
        if communities else "0"
    )
    top_rank = "row_number() over (partition by subreddit order by score desc, post_id)" if top_limit else "-score"
    top_cut = f"where listing_rank <= {top_limit}" if top_limit else ""
    hot_cut = f"and num_comments // 4 + 1 <= {hot_limit}" if hot_limit else ""
    return f"""
ranked as (select *, cast({top_rank} as bigint) as listing_rank from posts where {where} and {since}),
top_rows as (select *, 'top' as listing, 0 as p from ranked {top_cut}),
hot_rows as (select *, cast(num_comments // 4 + 1 as bigint) as listing_rank, 'hot' as listing, 1 as p
             from posts where {where} {hot_cut}),
listed as (select * replace (cast(({position}) * 2 + p as bigint) * 4294967296 + listing_rank as seq)
           from (select * from top_rows union all by name select * from hot_rows))"""


_DEFAULT = _listed(True, 50, 50, True)
_WHOLE = _listed(False, None, None, False)
_KEPT = """
kept as (select * from (select *, row_number() over (partition by post_id order by seq) as rn from listed)
         where rn = 1 and num_comments >= 10 and score >= 10)"""
_KEPT_COLUMNS = "select post_id, seq, listing, score, num_comments, title from kept"

_TOP_COMMENTS = f"""
cleaned as (select *, {_clean("raw_body")} as body from comments),
scored as (select *, score * ln(1 + length(body)) as score_len from cleaned
           where raw_body not in ('[deleted]', '[removed]')),
top_ranked as (select *, row_number() over (partition by post_id order by score_len desc, comment_id) as rank from scored),
top_comments as (select * from top_ranked where rank <= 10)"""


def _contains(columns: tuple[str, ...], terms: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(lower(coalesce({c}, '')), '{t}')" for c in columns for t in terms) + ")"


def _tag_list(source: str) -> str:
    both = ("title", "selftext")
    strip = _strip("coalesce(selftext, '')")
    rules = (
        ("potential_misinfo", _contains(both, tags.MISINFORMATION_TERMS)),
        ("conspiracy", _contains(both, tags.CONSPIRACY_TERMS)),
        ("conspiracy", "lower(subreddit) = 'conspiracy'"),
        ("high_engagement", "(num_comments > 300 or score > 1000)"),
        ("low_engagement", "(num_comments < 5 and score < 5)"),
        ("deleted_author", _contains(("author",), ("[deleted]",))),
        ("likely_satire", _contains(("flair",), tags.SATIRE_FLAIRS)),
        ("political", "(lower(subreddit) = 'politics' or "
                      + _contains(("flair",), tags.POLITICAL_FLAIRS) + ")"),
        ("theory_drop", f"length({strip}) > 1000"),
        ("url_only", f"{strip} = ''"),
    )
    cases = ", ".join(f"case when {cond} then '{tag}' end" for tag, cond in rules)
    return f"tagged as (select *, list_filter([{cases}], lambda x: x is not null) as tags from {source})"


_TAGGED = _tag_list("posts")
_CLEAN_POSTS = f"""
clean_posts as (select post_id, subreddit, author, {_clean("title")} as title, {_clean("selftext")} as selftext,
  score, num_comments, created_utc, flair, url, timestamp '2024-02-02 00:00:00' as collection_date, seq from posts)"""
_CLEAN_COMMENTS = f"""
clean_comments as (select comment_id, post_id, cast(null as varchar) as subreddit, author, raw_body,
  {_clean("raw_body")} as body, score, created_utc, parent_id,
  timestamp '2024-02-02 00:00:00' as collection_date, comment_seq from comments)"""

_TERMS = f"""
words as (select cluster_label, unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(selftext, '')),
            '{_WORD}{{2,}}')) as term from posts where {_IN_CLUSTER}),
terms as (select cluster_label, term, count(*) as n from words where term not in {_STOP} group by all),
keyword_ranks as (select * from (select *, cast(row_number() over (partition by cluster_label order by n desc, term) as int) as rank
            from terms) where rank <= 10)"""
_AUTHORS = f"""
authors as (select cluster_label, author, count(*) as n from posts where {_IN_CLUSTER} and author is not null group by all),
author_ranks as (select * from (select *, cast(row_number() over (partition by cluster_label order by n desc, author) as int) as rank
            from authors) where rank <= 3)"""
_FIRST_TITLES = f"""
first_titles as (select * from (select cluster_label, title, row_number() over (partition by cluster_label order by seq, post_id) as rank
            from posts where {_IN_CLUSTER}) where rank <= 5)"""
_SAMPLES = f"""
samples as (select * from (select cluster_label, post_id, title,
              cast(row_number() over (partition by cluster_label order by md5(post_id || '0'), post_id) as int) as rank
            from posts where {_IN_CLUSTER}) where rank <= 5)"""
_DAYS = f"""
days as (select cluster_label, cast(created_utc as date) as day, count(*) as n from posts where {_IN_CLUSTER} group by all)"""
_FLAGS = f"""
flags as (
  select b.cluster_label, b.size, b.burst, coalesce(a.m > 4, false) as concentrated, b.burst or coalesce(a.m > 4, false) as flagged
  from (select cluster_label, count(*) as size, max(created_utc) - min(created_utc) < interval '1' hour as burst
        from posts where {_IN_CLUSTER} group by 1) b
  left join (select cluster_label, max(n) as m from authors group by 1) a using (cluster_label))"""
_USERS = """
users as (select author, count(distinct cluster_label) as n_labels from posts where author is not null
          group by 1 having count(distinct cluster_label) > 1)"""


def _q(*ctes: str, select: str) -> str:
    return "with " + ",\n".join(c.strip() for c in ctes) + "\n" + select


_SAVED_POSTS = _q(_POSTS, _CLEAN_POSTS, select="select * from clean_posts")
_SAVED_COMMENTS = _q(_COMMENTS, _CLEAN_COMMENTS, select="select * from clean_comments")
_FILE_POSTS = _q(
    _POSTS, _CLEAN_POSTS, _tag_list("clean_posts"),
    select="select * replace (array_to_string(tags, ',') as tags) from tagged",
)

_THINNED = """
thinned as (select * replace (case n when 1 then '[deleted]' when 2 then '[removed]' else raw_body end as raw_body,
    coalesce(case when n = 3 then null else author end, 'None') as author, score + 2 as score)
  from (select *, (cast(post_id as bigint) * 8 + comment_seq) % 7 as n from comments))"""
_INJECTED = [t.upper() for t in (*tags.MISINFORMATION_TERMS, *tags.CONSPIRACY_TERMS)]
_PUT_IN = f"""
put_in as (select * replace (concat_ws(' ', title, {_INJECTED}[cast(seq % {len(_INJECTED) + 5} as int) + 1]) as title,
    case when seq % {len(_INJECTED) + 5} = {len(_INJECTED) + 1} then 4 else score end as score,
    case when seq % {len(_INJECTED) + 5} = {len(_INJECTED) + 1} then 4 else num_comments end as num_comments) from posts)"""

# Density clusters of the standardised vectors, from a spanning tree in the order it grows: the points that hang together
# below a distance are neighbours in it, so every merge is a span of that order.
_DENSITY = r"""
scaled as (
  select cast(vec_id as varchar) as post_id, unnest(range(len(embedding))) as i, cast(unnest(embedding) as double) as x from embeddings
), moments as (
  select i, avg(x) as mean, stddev_samp(x) as sd from scaled group by i
), vectors as (
  select post_id, array_agg(case when sd > 0 then (x - mean) / sd else 0 end order by i) as v from scaled join moments using (i) group by post_id
), points as materialized (
  select cast(row_number() over (order by post_id) as int) as p, post_id, v from vectors
), pairs as materialized (
  select a.p as a, b.p as b, list_distance(a.v, b.v) as d from points a, points b
), cores as materialized (
  select ms, a as p, d as core from (select distinct ms from runs),
    (select a, d, row_number() over (partition by a order by d) as nth from pairs) where nth = ms
), reach as materialized (
  select x.ms, q.a, q.b, greatest(q.d, x.core, y.core) as w
  from pairs q join cores x on x.p = q.a join cores y on y.p = q.b and y.ms = x.ms where q.a <> q.b
), prim(ms, s, p, h, nodes) as (
  -- a spanning tree, nearest node first; nodes: those not yet in it with their lightest edge to it
  select ms, cast(1 as bigint), 1, cast(null as double), list({'p': b, 'w': w}) from reach where a = 1 group by ms
  union all
  select t.ms, t.s + 1, t.pick.p, t.pick.w,
    (select list({'p': u.n.p, 'w': least(u.n.w, r.w)}) from (select unnest(t.nodes) as n) u join reach r on r.ms = t.ms and r.a = t.pick.p and r.b = u.n.p)
  from (select *, list_min(list_transform(nodes, lambda n: {'w': n.w, 'p': n.p})) as pick from prim where len(nodes) > 0) t
), tour as materialized (
  -- in this order the points that hang together below a distance stand side by side
  select ms, s, p, h, max(s) over (partition by ms) as n from prim
), spans as materialized (
  select x.ms, x.s, x.h, coalesce(max(y.s) filter (where y.s < x.s), 1) as lo, coalesce(min(y.s) filter (where y.s > x.s), any_value(x.n) + 1) - 1 as hi
  from tour x left join tour y on y.ms = x.ms and y.h > x.h where x.h is not null group by x.ms, x.s, x.h
), merges as materialized (
  select distinct m.ms, m.h, m.lo, m.hi, m.hi - m.lo + 1 as size, u.lo as up_lo, u.hi as up_hi from spans m
  left join tour l on l.ms = m.ms and l.s = m.lo and m.lo > 1 left join tour r on r.ms = m.ms and r.s = m.hi + 1
  left join spans u on u.ms = m.ms and u.s = case when r.h is null or l.h <= r.h then m.lo else m.hi + 1 end and (l.h is not null or r.h is not null)
), big as materialized (
  select r.run, m.*, 1 / greatest(m.h, 1e-12) as density from merges m join runs r using (ms) where m.size >= r.least
), held as materialized (
  select b.run, b.lo, b.hi, any_value(b.h) as h, any_value(b.size) as size, any_value(b.density) as density, any_value(b.up_lo) as up_lo, any_value(b.up_hi) as up_hi,
    count(c.lo) as inner_n, coalesce(sum(c.size), 0) as inner_size
  from big b left join big c on c.run = b.run and c.up_lo = b.lo and c.up_hi = b.hi group by b.run, b.lo, b.hi
), named(run, lo, hi, top_lo, top_hi) as (
  select run, lo, hi, lo, hi from held where up_lo is null
  union all
  select h.run, h.lo, h.hi, case when u.inner_n > 1 then h.lo else n.top_lo end, case when u.inner_n > 1 then h.hi else n.top_hi end
  from named n join held u on u.run = n.run and u.lo = n.lo and u.hi = n.hi join held h on h.run = u.run and h.up_lo = u.lo and h.up_hi = u.hi
), clusters as materialized (
  select n.run, n.top_lo as lo, n.top_hi as hi, any_value(t.up_lo) as up_lo, any_value(t.up_hi) as up_hi,
    sum((h.size - case when h.inner_n = 1 then h.inner_size else 0 end) * h.density) - any_value(t.size * coalesce(u.density, 0)) as stability,
    row_number() over (partition by n.run order by any_value(t.size), n.top_lo) as c
  from named n join held h on h.run = n.run and h.lo = n.lo and h.hi = n.hi join held t on t.run = n.run and t.lo = n.top_lo and t.hi = n.top_hi
  left join held u on u.run = t.run and u.lo = t.up_lo and u.hi = t.up_hi group by n.run, n.top_lo, n.top_hi
), tree as materialized (
  select k.run, k.c, k.stability, p.c as parent from clusters k left join named n on n.run = k.run and n.lo = k.up_lo and n.hi = k.up_hi
  left join clusters p on p.run = n.run and p.lo = n.top_lo and p.hi = n.top_hi
), families as materialized (
  select t.run, t.c, any_value(t.stability) as stability, any_value(t.parent) as parent, coalesce(list(k.c) filter (where k.c is not null), []) as kids
  from tree t left join tree k on k.run = t.run and k.parent = t.c group by t.run, t.c
), worth(run, c, worths, inside) as (
  -- smaller clusters first, so all inner ones are known
  select distinct run, cast(0 as bigint), cast([] as double[]), cast(null as double) from runs
  union all
  select w.run, f.c, list_append(w.worths, greatest(f.stability, coalesce(list_sum(list_transform(f.kids, lambda k: w.worths[k])), 0))),
    coalesce(list_sum(list_transform(f.kids, lambda k: w.worths[k])), 0)
  from worth w join families f on f.run = w.run and f.c = w.c + 1
), chosen(run, c, best) as (
  select run, c, cast(null as bigint) from families where parent is null
  union all
  select f.run, f.c, case when x.best is not null then x.best when f.stability >= w.inside then f.c end
  from chosen x join families f on f.run = x.run and f.parent = x.c join worth w on w.run = f.run and w.c = f.c
), landed as materialized (
  select r.run, t.s, t.p, (select min({'size': b.size, 'lo': b.lo, 'hi': b.hi}) from big b where b.run = r.run and t.s between b.lo and b.hi) as at
  from runs r join tour t using (ms)
), placed as materialized (
  select l.run, l.p, x.best from landed l left join named n on n.run = l.run and n.lo = l.at.lo and n.hi = l.at.hi
  left join clusters k on k.run = n.run and k.lo = n.top_lo and k.hi = n.top_hi left join chosen x on x.run = k.run and x.c = k.c
), numbers as (
  select run, best, row_number() over (partition by run order by min(p)) - 1 as number from placed where best is not null group by run, best
), labels as materialized (
  select l.run, q.post_id, cast(coalesce(number, -1) as int) as cluster_label from placed l join points q using (p) left join numbers using (run, best)
)"""


def _density(runs: list[tuple[int, int, int]], select: str) -> str:
    values = ", ".join(map(str, runs))
    return f"with recursive runs as (select * from (values {values}) r(run, least, ms)),{_DENSITY}{select}"


_SWEEP = [(size, samples) for size in (5, 10, 15, 20) for samples in (None, 5, 10)]
_SWEEP_NAMES = ", ".join(f"({i}, {size}, {samples or 'null'})" for i, (size, samples) in enumerate(_SWEEP))

_RECORDS = (_TERMS, _AUTHORS, _FIRST_TITLES, _SAMPLES, _DAYS, _FLAGS)
_RECORD_COLUMNS = """select f.cluster_label, f.size, f.flagged,
          (select string_agg(title, chr(10) order by rank) from first_titles x where x.cluster_label = f.cluster_label) as sample_text,
          (select string_agg(term, ',' order by term) from keyword_ranks x where x.cluster_label = f.cluster_label) as keywords,
          (select string_agg(author, ',' order by rank) from author_ranks x where x.cluster_label = f.cluster_label) as top_authors,
          (select string_agg(title, chr(10) order by rank) from samples x where x.cluster_label = f.cluster_label) as sample_posts,
          (select string_agg(day || '=' || n, ',' order by day) from days x where x.cluster_label = f.cluster_label) as timeline
          from flags f"""
# The same records of the posts that a collection without limits keeps, with cleaned text.
_RUN_REPORT = _q(
    _POSTS, _WHOLE, _KEPT,
    f"""saved as (select * replace ({_clean("title")} as title, {_clean("selftext")} as selftext) from kept)""",
    *[re.sub(r"\bposts\b", "saved", cte) for cte in _RECORDS],
    select=_RECORD_COLUMNS,
)

ORACLES: dict[str, str] = {
    "limited_comments": _q(
        _POSTS, _COMMENTS, _THINNED,
        select="""select comment_id, post_id, author, raw_body, score, comment_seq from
          (select *, row_number() over (partition by post_id order by comment_seq) as rn from thinned)
          where rn <= 3 and post_id in (select post_id from posts where num_comments >= 10 and score >= 10)""",
    ),
    "limited_top_comments": _q(
        _COMMENTS, _THINNED, f"cleaned as (select *, {_clean('raw_body')} as body from thinned)",
        select="""select post_id, cast(rank as int) as rank, comment_id, round(score_len, 6) as score_len from
          (select *, row_number() over (partition by post_id order by score_len desc, comment_id) as rank from
            (select *, score * ln(1 + length(body)) as score_len from cleaned where raw_body not in ('[deleted]', '[removed]')))
          where rank <= 3""",
    ),
    "injected_tags": _q(_POSTS, _PUT_IN, _tag_list("put_in"), select="select post_id, array_to_string(tags, ',') as tags from tagged"),
    "relanded_listing": _q(
        _POSTS,
        select=f"""select subreddit, listing_rank, post_id, score, 3 as landed_at from
          (select subreddit, post_id, score - 21 as score, row_number() over (partition by subreddit order by score desc, post_id) as listing_rank
           from posts where subreddit in {_LISTED_COMMUNITIES}
             and created_utc between timestamp '2024-02-02 00:00:00' - interval '1' month and timestamp '2024-02-02 00:00:00')
          where listing_rank <= 3""",
    ),
    "landed_rejects": """
        select case when (conv_id * 8 + turn) % 5 = 0 then 'rejected' else 'good' end as kind, count(*) as n,
          count(distinct case when (conv_id * 8 + turn) % 5 = 0 then null else conv_id end) as posts
        from conversations group by 1""",
    "top_listing": _q(_POSTS, _DEFAULT, select="select subreddit, listing_rank, post_id, score from top_rows"),
    "hot_listing": _q(_POSTS, _DEFAULT, select="select subreddit, listing_rank, post_id from hot_rows"),
    "listings": _q(_POSTS, _DEFAULT, select="select seq, post_id, listing from listed"),
    "kept_posts": _q(_POSTS, _DEFAULT, _KEPT, select=_KEPT_COLUMNS),
    "kept_posts_all_communities": _q(_POSTS, _WHOLE, _KEPT, select=_KEPT_COLUMNS),
    "clean_posts": _SAVED_POSTS,
    "clean_page_text": f"select page_id, {_clean('html')} as text, {_clean('url')} as url from pages",
    "post_comments": _q(
        _POSTS, _COMMENTS,
        select="""select comment_id, post_id, comment_seq from
          (select *, row_number() over (partition by post_id order by comment_seq) as rn from comments)
          where rn <= 50 and post_id in (select post_id from posts where num_comments >= 10 and score >= 10)""",
    ),
    "clean_comments": _SAVED_COMMENTS,
    "top_comment_ranks": _q(
        _COMMENTS, _TOP_COMMENTS,
        select="select post_id, cast(rank as int) as rank, comment_id, body, round(score_len, 6) as score_len from top_comments",
    ),
    "comment_text": _q(
        _POSTS, _COMMENTS, _TOP_COMMENTS,
        select="""select p.post_id, cast(count(t.rank) as int) as n_comments,
          coalesce(string_agg(t.body, chr(10) order by t.rank), '') as comment_text
          from posts p left join top_comments t using (post_id) group by 1""",
    ),
    "post_tags": _q(_POSTS, _TAGGED, select="select post_id, array_to_string(tags, ',') as tags from tagged"),
    "tag_counts": _q(
        _POSTS, _TAGGED,
        select="select subreddit, tag, count(*) as n from (select subreddit, unnest(tags) as tag from tagged) group by all",
    ),
    "collected_posts": _q(
        _POSTS, _COMMENTS, _DEFAULT, _KEPT, _TOP_COMMENTS,
        f"""kept_clean as (select * replace ({_clean("title")} as title, {_clean("selftext")} as selftext) from kept)""",
        _tag_list("kept_clean"),
        """joined as (select post_id, string_agg(body, chr(10) order by rank) as top_comments from top_comments group by 1)""",
        select="""select t.post_id, subreddit, author, title, seq, array_to_string(tags, ',') as tags,
          coalesce(top_comments, '') as top_comments from tagged t left join joined using (post_id)""",
    ),
    "collected_comments": _q(
        _POSTS, _COMMENTS, _DEFAULT, _KEPT, _CLEAN_COMMENTS,
        select="""select comment_id, post_id, author, body, score, parent_id, created_utc from
          (select *, row_number() over (partition by post_id order by comment_seq) as rn from clean_comments)
          where rn <= 50 and post_id in (select post_id from kept)""",
    ),
    "unvectorised_posts": _q(
        _POSTS,
        select="select post_id, subreddit from posts where post_id not in (select cast(vec_id as varchar) from embeddings)",
    ),
    "labelled_posts": _q(_POSTS, select="select post_id, seq, cluster_label from posts"),
    "cluster_count": "select count(distinct label) as n_clusters from embeddings where label - 1 <> -1",
    "label_size_statistics": """
        select 10 as min_cluster_size, 5 as min_samples, cast(count_if(label <> 0) as bigint) as n_clusters,
          cast(coalesce(sum(n) filter (label = 0), 0) as bigint) as n_noise, max(n) as largest,
          median(n) as median, avg(n) filter (label <> 0) as mean
        from (select label, count(*) as n from embeddings group by 1)""",
    "cluster_sizes": _q(_POSTS, select=f"select cluster_label, count(*) as size from posts where {_IN_CLUSTER} group by 1"),
    "keyword_ranks": _q(_POSTS, _TERMS, select="select cluster_label, term, n, rank from keyword_ranks"),
    "keywords": _q(
        _POSTS, _TERMS,
        select="select cluster_label, string_agg(term, ', ' order by term) as keywords from keyword_ranks group by 1",
    ),
    "sample_text": _q(
        _POSTS, _FIRST_TITLES,
        select="select cluster_label, string_agg(title, chr(10) order by rank) as sample_text from first_titles group by 1",
    ),
    "author_ranks": _q(_POSTS, _AUTHORS, select="select cluster_label, author, n, rank from author_ranks"),
    "sample_posts": _q(_POSTS, _SAMPLES, select="select cluster_label, post_id, title, rank from samples"),
    "daily_timeline": _q(_POSTS, _DAYS, select="select cluster_label, day, n from days"),
    "cluster_flags": _q(_POSTS, _AUTHORS, _FLAGS, select="select cluster_label, size, burst, concentrated, flagged from flags"),
    "flagged_users": _q(_POSTS, _USERS, select="select author, n_labels from users"),
    "flagged_users_without_noise": _q(
        _POSTS,
        select=f"""select author, count(distinct cluster_label) as n_labels from posts
          where author is not null and {_IN_CLUSTER} group by 1 having count(distinct cluster_label) > 1""",
    ),
    "headline": _q(
        _POSTS, _USERS,
        select="""select (select count(distinct cluster_label) from posts where cluster_label <> -1) as clusters,
          (select count(*) from posts) as posts, (select count(*) from users) as flagged_users""",
    ),
    "cluster_records": _q(_POSTS, *_RECORDS, select=_RECORD_COLUMNS),
    **{name: _RUN_REPORT for name in ("run_report", "run_from_csv", "run_from_json")},
    "new_posts": _q(
        _POSTS, _listed(False, 50, None, True),
        select="select post_id, subreddit, listing from hot_rows where post_id not in (select post_id from top_rows)",
    ),
    "new_comments": _q(
        _COMMENTS,
        select="""select comment_id, post_id, comment_seq from
          (select *, row_number() over (partition by post_id order by comment_seq) as rn from comments) where rn > 1""",
    ),
    "orphan_comments": _q(
        _POSTS, _COMMENTS, _DEFAULT, _KEPT,
        select="select comment_id, post_id from comments where post_id not in (select post_id from kept)",
    ),
    "saved_posts": _SAVED_POSTS,
    "saved_comments": _SAVED_COMMENTS,
    "json_posts": _FILE_POSTS,
    "csv_posts": _FILE_POSTS,
    "csv_comments": _SAVED_COMMENTS,
    "epoch_times": """
        select event_id, date_trunc('second', ts) as created_utc,
          strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') as iso, ts as parsed from events""",
    "token_counts": f"""
        select term, count(*) as n from
          (select unnest(regexp_extract_all(lower(text), '{_WORD}{{2,}}')) as term from documents) group by 1""",
    "text_lengths": _q(
        _POSTS,
        select=f"""select post_id, cast(length({_strip("selftext")}) as int) as n_stripped,
          round(ln(1 + length(selftext)), 6) as log_length,
          cast(length(title || ' ' || selftext) as int) as n_text from posts""",
    ),
    "standardised_vectors": """
        with cells as (select cast(vec_id as varchar) as post_id, unnest(range(len(embedding))) as i,
                         cast(unnest(embedding) as double) as x from embeddings),
        moments as (select i, avg(x) as m, stddev_samp(x) as s from cells group by 1)
        select post_id, cast(i as int) as dim, round((x - m) / s, 6) as value from cells join moments using (i)""",
    "text_weights": _q(
        _COMMENTS, _TOP_COMMENTS,
        f"""terms as (select post_id, unnest(regexp_extract_all(lower(body), '{_WORD}{{2,}}')) as term from top_comments)""",
        f"""counts as (select post_id, cast(cast('0x' || substr(md5(term), 1, 7) as bigint) % 768 as int) as bucket, count(*) as tf
          from terms where term not in {_STOP} group by 1, 2)""",
        """weighted as (select post_id, bucket, tf * ln((total + 1.0) / (df + 1)) as w from counts
          join (select bucket, count(*) as df from counts group by 1) using (bucket), (select count(distinct post_id) as total from counts))""",
        """lengths as (select post_id, sqrt(sum(w * w)) as norm from weighted group by 1)""",
        select="select post_id, bucket, round(case when norm > 0 then w / norm else 0 end, 6) as weight from weighted join lengths using (post_id)",
    ),
    "full_density_labels": _density([(0, 10, 5)], "select post_id, cluster_label from labels"),
    "full_density_sweep": _density(
        [(i, size, samples or size) for i, (size, samples) in enumerate(_SWEEP)],
        f"""select min_cluster_size, min_samples, count_if(cluster_label >= 0) as n_clusters,
          cast(coalesce(sum(n) filter (where cluster_label < 0), 0) as bigint) as n_noise, max(n) as largest, median(n) as median,
          avg(n) filter (where cluster_label >= 0) as mean
          from (select run, cluster_label, count(*) as n from labels group by 1, 2)
          join (values {_SWEEP_NAMES}) x(run, min_cluster_size, min_samples) using (run) group by run, 1, 2""",
    ),
    "reduced_distances": """
        with cells as (select cast(vec_id as varchar) as post_id, unnest(range(len(embedding))) as i,
                         cast(unnest(embedding) as double) as x from embeddings),
        moments as (select i, avg(x) as m, stddev_samp(x) as s from cells group by 1),
        rows as (select post_id, array_agg((x - m) / s order by i) as v from cells join moments using (i) group by 1),
        following as (select post_id, v, lead(post_id) over (order by post_id) as other, lead(v) over (order by post_id) as v2 from rows)
        select post_id, other, round(list_distance(v, v2), 6) as d from following where other is not null""",
    "core_distances": """
        with near as (
          select a.vec_id, list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])) as d,
            row_number() over (partition by a.vec_id order by list_distance(cast(a.embedding as double[]), cast(b.embedding as double[]))) as rn
          from embeddings a, embeddings b)
        select cast(vec_id as varchar) as post_id, round(d, 6) as core from near where rn = 5""",
}
