"""The registered queries of this package and the SQL that DuckDB can hold them against.

SQL is given for the URL filters, the mixing, whose rates it takes as quotients, the source audit, and the
clustering, whose rounds it writes out. The other operators fit a model, use a tokenizer or a hash that DuckDB lacks, or
iterate; tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm import (
    decontamination,
    html_extraction,
    license_scan,
    mixing,
    perplexity,
    quality_nbsvm,
    simhash,
    source_divergence,
    token_histogram,
    tool_calls,
    toxicity,
    url_filters,
    walsh_clusters,
)
from parcelwise.llm.common import table

HEX = "0123456789abcdef"


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures from ``pages``: the page is fetched on a day of 2024 that follows from its id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int")).alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated list entries from the hosts and first path segments of ``pages``, by digits of an MD5."""
    digit = lambda c, k: F.instr(F.lit(HEX), F.substr(F.md5(c), F.lit(k), F.lit(1))) - 1
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    entry = lambda name, pattern, action, decision, when: F.struct(
        F.lit(name).alias("list"), pattern.alias("pattern"), F.lit(action).alias("action"), F.lit(decision).alias("decision"), day(when).alias("day")
    )
    host = F.col("host")
    parent = F.regexp_replace(host, r"^[^.]*\.", "")
    hosts = pages.select(url_filters.host(F.col("url")).alias("host")).where("host <> ''").distinct()
    by_host = F.array_compact(F.array(
        F.when(digit(host, 1) < 8, entry("abuse", host, "add", "block", 11 * digit(host, 2))),
        F.when((digit(host, 1) < 8) & (digit(host, 3) < 8), entry("abuse", host, "remove", "block", 11 * digit(host, 2) + 60)),
        F.when((digit(host, 1) < 8) & (digit(host, 3) < 4), entry("abuse", host, "add", "block", 11 * digit(host, 2) + 120)),
        F.when(digit(host, 4) < 3, entry("trusted", host, "add", "allow", 20 * digit(host, 5))),
        F.when(digit(parent, 6) < 4, entry("abuse", parent, "add", "block", 200 + 5 * digit(parent, 7))),
    ))
    places = pages.select(F.element_at(url_filters.patterns(F.col("url")), -1).alias("host")).where("host like '%/%'").distinct()
    by_place = F.array_compact(F.array(F.when(digit(host, 1) < 3, entry("spam", host, "add", "block", 20 * digit(host, 2)))))
    listed = hosts.select(F.explode(by_host).alias("e")).unionByName(places.select(F.explode(by_place).alias("e")))
    return listed.select("e.*").distinct()


def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of ``pages`` as a capture, against dated entries derived from the same table."""
    pages = table(spark, folder, "pages")
    return url_filters.evaluated(captures_of(pages), entries_of(pages))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_nbsvm.classified(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_histogram.histogram(table(spark, folder, "documents"))


def op5_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.main_texts(table(spark, folder, "pages"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classified(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"))


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


SCHEMAS = {
    "search": {"type": "object", "required": ["limit", "query"], "additionalProperties": False,
               "properties": {"query": {"type": "string", "minLength": 1, "maxLength": 400}, "limit": {"type": "integer", "minimum": 0, "maximum": 40}}},
    "count": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}},
}


def calls_of(talks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from ``conversations``: an assistant turn calls, the user's next turn answers.

    A call rests on the one before it, but for every fourth. Tools, arguments and their faults follow
    from turn and text; the argument holds the whole text of the turn.
    """
    turn, text = F.col("turn"), F.col("text")
    told = F.to_json(F.struct(text.alias("query"), (F.length(text) % 50).alias("limit")))
    calls = talks.where("role = 'assistant'").select(
        "conv_id", F.concat(F.lit("c"), turn).alias("call_id"), "turn",
        F.element_at(F.array(F.lit("search"), F.lit("count"), F.lit("search"), F.lit("unknown")), (F.length(F.coalesce(text, F.lit(""))) % 4 + 1).cast("int")).alias("name"),
        F.when(F.length(text) % 11 == 0, F.rtrim(told, F.lit("}"))).otherwise(told).alias("arguments"),
        F.when((turn / 2).cast("long") % 4 != 0, F.concat(F.lit("c"), turn - 2)).alias("after"),
    )
    results = talks.where("role = 'user' and turn > 0").select(
        "conv_id", F.concat(F.lit("c"), turn - 1).alias("call_id"), "turn", text.alias("content")
    )
    return calls, results


def op9_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls and results derived from the whole of ``conversations``, linked."""
    return tool_calls.linked(*calls_of(table(spark, folder, "conversations")), SCHEMAS)


def op10_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    return perplexity.judged(table(spark, folder, "documents"))


def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.audited(table(spark, folder, "documents"))


def op12_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return walsh_clusters.clustered(table(spark, folder, "embeddings"))


def op13_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scanned(table(spark, folder, "documents"))
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return found.withColumns(joined).drop("spans")


QUERIES = {f.__name__: f for f in (
    op1_url_filters, op2_quality, op3_decontamination, op4_token_counts, op5_html, op6_toxicity, op7_mixing, op8_simhash,
    op9_tool_calls, op10_perplexity, op11_divergence, op12_clusters, op13_licenses,
)}

_HOST = url_filters.HOST
_PATH = url_filters.PATH


def _digit(text: str, k: int) -> str:
    return f"(instr('{HEX}', substr(md5({text}), {k}, 1)) - 1)"


def _entry(name: str, pattern: str, action: str, decision: str, day: str, source: str, where: str) -> str:
    return (
        f"select '{name}' as list, {pattern} as pattern, '{action}' as action, '{decision}' as decision, "
        f"date '2024-01-01' + cast({day} as int) as day from {source} where {where}"
    )


_PARENT = r"regexp_replace(host, '^[^.]*\.', '')"
OP1_SQL = rf"""
with captures as (
  select page_id, url, date '2024-01-01' + cast(page_id % 365 as int) as fetched,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '{_HOST}', 1)), '\.$', '') as host,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '{_PATH}', 1), '/'), lambda s: s <> '') as segments
  from pages
), named as (
  select *, case when host = '' then [] else list_distinct(list_concat(
    list_transform(generate_series(1, greatest(len(string_split(host, '.')) - 1, 1)), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(generate_series(1, len(segments)), lambda i: host || '/' || array_to_string(segments[1:i], '/')))) end as patterns
  from captures
), hosts as (select distinct host from captures where host <> ''),
places as (select distinct host || '/' || array_to_string(segments, '/') as host from captures where host <> '' and len(segments) > 0),
entries as (
  {" union ".join((
      _entry("abuse", "host", "add", "block", f"11 * {_digit('host', 2)}", "hosts", f"{_digit('host', 1)} < 8"),
      _entry("abuse", "host", "remove", "block", f"11 * {_digit('host', 2)} + 60", "hosts", f"{_digit('host', 1)} < 8 and {_digit('host', 3)} < 8"),
      _entry("abuse", "host", "add", "block", f"11 * {_digit('host', 2)} + 120", "hosts", f"{_digit('host', 1)} < 8 and {_digit('host', 3)} < 4"),
      _entry("trusted", "host", "add", "allow", f"20 * {_digit('host', 5)}", "hosts", f"{_digit('host', 4)} < 3"),
      _entry("abuse", _PARENT, "add", "block", f"200 + 5 * {_digit(_PARENT, 7)}", "hosts", f"{_digit(_PARENT, 6)} < 4"),
      _entry("spam", "host", "add", "block", f"20 * {_digit('host', 2)}", "places", f"{_digit('host', 1)} < 3"),
  ))}
), days as (
  select list, pattern, day, min(action) as action, min(case when action = 'add' then decision end) as decision from entries group by all
), events as (
  select *, row_number() over (partition by list, pattern order by day) as n from days
), asked as (
  select distinct page_id, url, fetched, unnest(patterns) as pattern from named
), latest as (
  select a.page_id, a.url, a.fetched, a.pattern, e.list, max(e.n) as n
  from asked a join events e on a.pattern = e.pattern and e.day <= a.fetched group by all
), active as (
  select l.page_id, l.url, l.fetched, l.pattern, e.decision
  from latest l join events e on l.pattern = e.pattern and l.list = e.list and l.n = e.n where e.action = 'add'
), ranked as (
  select *, count(*) over (partition by page_id, url, fetched) as n_active,
    row_number() over (partition by page_id, url, fetched order by length(pattern) desc, pattern, decision) as k
  from active
)
select c.page_id, c.url, c.fetched, c.host, coalesce(r.n_active, 0) as n_active, r.pattern, coalesce(r.decision, 'allow') as decision
from captures c left join ranked r on r.k = 1 and c.page_id is not distinct from r.page_id and c.url is not distinct from r.url
  and c.fetched is not distinct from r.fetched
"""

_STEP = mixing.UNIT // mixing.STARTS


def _copies(start: str) -> str:
    return (
        f"(scaled // {mixing.UNIT} + ((scaled % {mixing.UNIT}) * rank + {start}) // {mixing.UNIT} "
        f"- ((scaled % {mixing.UNIT}) * (rank - 1) + {start}) // {mixing.UNIT})"
    )


OP7_SQL = rf"""
with recursive sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents
), totals as (
  select source, cast(sum(size) as bigint) as source_size from sized group by source
), weighed as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight,
    row_number() over (order by source nulls last) as n from totals
), rounds as (
  -- stop what exceeds three times its source, reshare the rest, until none exceeds
  select 0 as round, n, source_size, weight, false as stopped from weighed
  union all
  select round + 1, n, source_size, weight, stopped or
    weight * (sum(source_size) over () - coalesce(sum(case when stopped then 3 * source_size end) over (), 0))
      >= 3 * source_size * sum(case when stopped then 0 else weight end) over ()
  from rounds where round < (select count(*) from weighed)
), targets as (
  select w.source, w.source_size, case when r.stopped then cast(3 * w.source_size as double)
    else r.weight * cast(sum(r.source_size) over () - coalesce(sum(case when r.stopped then 3 * r.source_size end) over (), 0) as bigint)
      / cast(sum(case when r.stopped then 0 else r.weight end) over () as bigint) end as target
  from rounds r join weighed w on r.n = w.n where r.round = (select max(round) from rounds)
), rates as (
  select *, case when source_size > 0 then least(cast(round(target / source_size * {mixing.UNIT}) as bigint), {mixing.MOST * mixing.UNIT}) else 0 end as scaled
  from targets
), ranked as (
  select s.doc_id, s.source, s.size, row_number() over (partition by s.source order by
    20 * length(cast(s.size as varchar)) + cast(substr(cast(s.size as varchar), 1, 2) as int) // 5,
    {_digit("coalesce(cast(s.doc_id as varchar), '')", 1)} + 16 * ({_digit("coalesce(cast(s.doc_id as varchar), '')", 2)} % 4),
    s.size, s.doc_id nulls first) as rank
  from sized s
), joined as (
  select r.*, t.source_size, t.target, t.scaled from ranked r join rates t on r.source is not distinct from t.source
), starts as (
  select {_STEP} * i + {_STEP // 2} as start from range({mixing.STARTS}) x(i)
), tried as (
  select source, start, abs(sum(size * {_copies("start")}) - any_value(target)) as miss from joined, starts group by source, start
), best as (
  select source, start from (select *, row_number() over (partition by source order by miss, start) as k from tried) where k = 1
)
select doc_id, size, source_size, target, cast(scaled as double) / {mixing.UNIT} as rate, cast({_copies("start")} as bigint) as copies,
  cast(size * {_copies("start")} as bigint) as taken
from joined j join best b on j.source is not distinct from b.source
"""


OP11_SQL = rf"""
with docs as (
  select row_number() over () as rid, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents
), words as materialized (
  select rid, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs
), kept as materialized (
  select lang, term, count(*) as n from words group by lang, term having count(distinct rid) >= {source_divergence.LEAST_DOCS}
), langs as (
  select lang, cast(count(*) as bigint) as v, cast(sum(n) as bigint) as total from kept group by lang
), sources as (select distinct lang, source from docs),
counted as (
  select w.lang, w.source, w.term, count(*) as c from words w semi join kept k on w.lang = k.lang and w.term = k.term group by all
), shares as materialized (
  select lang, source, term, c, 1 + ({source_divergence.UNIT} * (c + 1)) // (cast(sum(c) over (partition by lang, source) as bigint) + v) as p,
    1 + ({source_divergence.UNIT} * (n + 1)) // (total + v) as q
  from (select s.lang, s.source, k.term, k.n, l.v, l.total, coalesce(d.c, 0) as c from sources s join kept k on s.lang = k.lang
    join langs l on s.lang = l.lang left join counted d on d.lang = s.lang and d.source = s.source and d.term = k.term)
), pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), found as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(p.value, 0) as bigint) as value
  from sources a join sources b on a.lang = b.lang and a.source <> b.source
  left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
  union all
  select lang, source, 'term', term, (p - q) * (p - q) // q from shares where c > 0 and p > q
)
select * from (
  select lang, source, part, item, value, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from found)
where part = 'pair' or rank <= {source_divergence.TOP}
"""


def _round(n: int) -> str:
    """Vectors to their nearest centroid, and the centroids that follow from it."""
    return f"""
nearest{n} as materialized (
  select rid, c, distance from (
    select rid, c, distance, row_number() over (partition by rid order by distance, c) as k from (
      select k.rid, c.c, cast(list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) as bigint) as distance
      from kept k, centres{n} c)) where k = 1
), sums{n} as (
  select c, i, cast(sum(x) as bigint) as s, count(*) as n from (
    select a.c, unnest(k.v) as x, unnest(range(1, 65)) as i from kept k join nearest{n} a on k.rid = a.rid) group by c, i
), centres{n + 1} as materialized (
  select o.c, coalesce(m.v, o.v) as v from centres{n} o
  left join (select c, list((s - ((s % n) + n) % n) // n order by i) as v from sums{n} group by c) m on o.c = m.c
)"""


_LAST = walsh_clusters.ROUNDS
OP12_SQL = f"""
with kept as materialized (
  select row_number() over () as rid, vec_id,
    list_transform(embedding, lambda x: cast(floor({walsh_clusters.SCALE} * cast(x as double)) as bigint)) as v
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
), centres0 as materialized (
  select c, v from (select row_number() over (order by sha256('{walsh_clusters.SEED}:' || coalesce(cast(vec_id as varchar), '')), v) - 1 as c, v from kept)
  where c < {walsh_clusters.CLUSTERS}
), {",".join(_round(n) for n in range(_LAST + 1))}
select k.vec_id, cast(a.c as int) as cluster, a.distance, cast(sum(a.distance) over (partition by a.c) as bigint) as cluster_inertia,
  cast(sum(a.distance) over () as bigint) as inertia,
  sha256(array_to_string(list_transform(o.v, lambda x: cast(x as varchar)), ',')) as centroid_sha256
from kept k join nearest{_LAST} a on k.rid = a.rid join centres{_LAST} o on a.c = o.c
"""

ORACLES = {"op1_url_filters": OP1_SQL, "op7_mixing": OP7_SQL, "op11_divergence": OP11_SQL, "op12_clusters": OP12_SQL}
