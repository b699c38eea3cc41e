"""Registered queries of the library's own operators over the driver's tables, and SQL that gives the same rows.

Documents play both relations of the planner: every document is an expected entry with the SHA-1 of its text, and every
document is a source file whose content is the text without the letter ``w``: texts without that letter match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge import file_queries
from setforge.functions import paths, text
from setforge.functions.rules import Rule, category
from setforge.operators import admission, catalogue, profile
from setforge.plans import planner

Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(sql: str):
    def put(f):
        Q[f.__name__] = (f, sql)
        return f

    return put


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def entries(spark, sf) -> DataFrame:
    d = t(spark, sf, "documents")
    parent = F.when(F.col("doc_id") % 3 == 0, F.col("lang"))
    return d.select(F.col("lang").alias("dat_name"), F.col("source").alias("game_name"), parent.alias("parent_name"), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("rom_name"), F.sha1("text").alias("sha1"))


def sources(spark, sf) -> DataFrame:
    d = t(spark, sf, "documents")
    root = F.concat(F.lit("/src/"), "source")
    kind = F.when(F.col("doc_id") % 3 == 0, "bare").when(F.col("doc_id") % 3 == 1, "zip").otherwise("archive")
    entry = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("doc_"), "doc_id"))
    return d.select(root.alias("source_root"), F.concat_ws("/", root, "doc_id").alias("canonical_path"), entry.alias("entry_name"), kind.alias("kind"), F.sha1(F.replace("text", F.lit("w"), F.lit(""))).alias("sha1"), F.col("doc_id").alias("seq"))


REL = """with dat as (
  select lang as dat_name, source as game_name, case when doc_id % 3 = 0 then lang end as parent_name,
         'doc_' || doc_id || '.txt' as rom_name, sha1(text) as sha1 from documents),
src as (
  select '/src/' || source as source_root, '/src/' || source || '/' || doc_id as canonical_path,
         case when doc_id % 3 > 0 then 'doc_' || doc_id end as entry_name, doc_id % 3 as prio, doc_id as seq,
         sha1(replace(text, 'w', '')) as sha1 from documents),
cand as (select *, row_number() over w as rn, count(*) over (partition by sha1) as n_candidates,
           canonical_path || coalesce(':' || entry_name, '') as display
         from src window w as (partition by sha1 order by prio, canonical_path, entry_name nulls first, seq)),
best as (select * from cand where rn = 1),
res as (select d.*, b.sha1 is not null as hit, b.n_candidates, b.display, b.canonical_path, b.entry_name
        from dat d left join best b using (sha1))
"""


# --- planner ---------------------------------------------------------------------------------------------------------


@query(REL + """select coalesce(parent_name, game_name) || '.zip' as zip, count(*) as roms, count(*) filter (hit) as matched,
  count(*) filter (not hit) as missing, count(*) filter (n_candidates > 1) as duplicates from res group by 1""")
def flagship_bundle_summary(spark, sf):
    return planner.bundle_summary(entries(spark, sf), sources(spark, sf))


@query(REL + "select game_name, rom_name, sha1 from res where not hit")
def missing_roms(spark, sf):
    return planner.missing(entries(spark, sf), sources(spark, sf))


@query(REL + "select game_name, rom_name, sha1 from res where hit")
def matched_roms_semi(spark, sf):
    return planner.matched(entries(spark, sf), sources(spark, sf)).select("game_name", "rom_name", "sha1")


@query(REL + "select sha1, display, n_candidates from best")
def best_source_pick(spark, sf):
    best = planner.best_sources(sources(spark, sf))
    return best.select("sha1", planner.display_name(F.col("best.canonical_path"), F.col("best.entry_name")).alias("display"), "n_candidates")


@query(REL + "select rom_name, sha1, display as selected, n_candidates from res where n_candidates > 1")
def duplicate_matches(spark, sf):
    return planner.duplicate_matches(entries(spark, sf), sources(spark, sf))


@query(REL + "select r.rom_name, r.sha1, c.display as candidate from res r join cand c using (sha1) where r.n_candidates > 1")
def duplicate_candidates(spark, sf):
    return planner.candidate_rows(entries(spark, sf), sources(spark, sf))


@query(REL + "select sha1, string_agg(display, '|' order by rn) as candidates from cand group by 1")
def candidate_lists(spark, sf):
    lists = planner.candidate_lists(sources(spark, sf))
    return lists.select("sha1", F.array_join(F.transform("candidates", lambda c: planner.display_name(c["canonical_path"], c["entry_name"])), "|").alias("candidates"))


@query(REL + """, h as (select *, prio || ':' || display || ':' || seq as item, case when seq % 3 = 0 then 'hot' else sha1 end as digest from cand),
  k as (select *, row_number() over (partition by digest order by prio, canonical_path, entry_name nulls first, seq) - 1 as nr from h)
  select digest, cast(nr // 50 as bigint) as chunk, string_agg(item, '|' order by nr) as candidates, count(*) as n from k group by 1, 2""")
def candidate_chunks(spark, sf):
    """A digest with a third of all sources, in lists of at most 50; keys of over 200 rows are dealt out."""
    s = sources(spark, sf).withColumn("sha1", F.when(F.col("seq") % 3 == 0, F.lit("hot")).otherwise(F.col("sha1")))
    lists = planner.candidate_chunks(s, most=50, hot=200)
    item = lambda c: F.concat_ws(":", c["prio"], planner.display_name(c["canonical_path"], c["entry_name"]), c["seq"])
    return lists.select(F.col("sha1").alias("digest"), "chunk", F.array_join(F.transform("candidates", item), "|").alias("candidates"), F.size("candidates").cast("long").alias("n"))


@query(REL + """, h as (select *, row_number() over (partition by dat_name order by game_name, parent_name nulls first, rom_name, canonical_path) - 1 as nr from res where hit)
  select dat_name || '.zip' as zip, cast(nr // 50 as bigint) as chunk, string_agg(rom_name, '|' order by nr) as entries from h group by 1, 2""")
def bundle_chunks(spark, sf):
    """Bundles of a whole language, in lists of at most 50 entries."""
    b = planner.bundle_chunks(entries(spark, sf).withColumns({"game_name": F.col("dat_name"), "dat_name": F.col("game_name")}), sources(spark, sf), planner.PER_GAME, most=50, hot=200)
    return b.select("zip", "chunk", F.array_join(F.transform("entries", lambda e: e["rom_name"]), "|").alias("entries"))


@query(REL + """, r as (select distinct '/src/' || source as root from documents where doc_id % 2 = 0 union select '/src' union select '/src/' || source || '/' || doc_id from documents where doc_id % 7 = 0)
  select root, canonical_path, seq from src join r on source_root = root or canonical_path = root or starts_with(canonical_path, root || '/')""")
def sources_of_roots(spark, sf):
    """The sources under each of many roots: folders, single files, one above all."""
    d, root = t(spark, sf, "documents"), F.concat(F.lit("/src/"), "source")
    roots = d.filter("doc_id % 2 = 0").select(root.alias("root")).union(d.filter("doc_id % 7 = 0").select(F.concat_ws("/", root, "doc_id"))).union(d.select(F.lit("/src/")).distinct())
    return planner.sources_of_roots(sources(spark, sf), roots).select("root", "canonical_path", "seq")


@query(REL + "select coalesce(parent_name, game_name) || '.zip' as zip, rom_name, display as source from res where hit")
def bundle_entries_parent(spark, sf):
    e = planner.bundle_entries(entries(spark, sf), sources(spark, sf))
    return e.select("zip", "rom_name", planner.display_name(F.col("canonical_path"), F.col("entry_name")).alias("source"))


@query(REL + """select game_name || '.zip' as zip, string_agg(rom_name || '=' || display, '|' order by dat_name, parent_name nulls first, rom_name) as entries
  from res where hit group by 1""")
def bundle_entries_per_game(spark, sf):
    b = planner.bundles(entries(spark, sf), sources(spark, sf), planner.PER_GAME)
    line = lambda e: F.concat_ws("=", e["rom_name"], planner.display_name(e["canonical_path"], e["entry_name"]))
    return b.select("zip", F.array_join(F.transform("entries", line), "|").alias("entries"))


@query(REL + """select count(*) filter (hit) as matched, count(*) filter (not hit) as missing, count(*) filter (n_candidates > 1) as duplicates,
  cast(case when count(*) filter (not hit) > 0 then 2 else 0 end as integer) as exit_code,
  count(*) filter (hit) > 0 and count(*) filter (not hit) = 0 as writes_files from res""")
def strict_gate(spark, sf):
    return planner.summary(entries(spark, sf), sources(spark, sf), strict=True)


@query(REL + "select source_root, canonical_path from src where source_root = '/src/src1' or canonical_path = '/src/src1' or starts_with(canonical_path, '/src/src1/')")
def source_root_scope(spark, sf):
    return planner.scope_sources(sources(spark, sf), "/src/src1").select("source_root", "canonical_path")


@query(REL + "select game_name, rom_name from dat where dat_name = 'fr'")
def entry_scope(spark, sf):
    return planner.scope_entries(entries(spark, sf), "fr").select("game_name", "rom_name")


# --- store -----------------------------------------------------------------------------------------------------------


@query(REL + """select canonical_path, sha1, 'old' as version from src where not starts_with(canonical_path, '/src/src1/') and canonical_path <> '/src/src1'
  union all select canonical_path, sha1(sha1), 'new' from src where starts_with(canonical_path, '/src/src1/')""")
def replace_root_rows(spark, sf):
    old = sources(spark, sf).select("canonical_path", "sha1", F.lit("old").alias("version"))
    new = planner.scope_sources(sources(spark, sf), "/src/src1").select("canonical_path", F.sha1("sha1").alias("sha1"), F.lit("new").alias("version"))
    return catalogue.replace_under_root(old, new, "/src/src1", "canonical_path")


@query("select n_name as game, r_name as dat, n_nationkey as rom from nation join region on n_regionkey = r_regionkey where r_regionkey = 1")
def catalog_join(spark, sf):
    games = t(spark, sf, "region").select(F.col("r_regionkey").alias("id"), "r_name", F.col("r_regionkey").alias("data_file_id"))
    roms = t(spark, sf, "nation").withColumnRenamed("n_regionkey", "game_id")
    return catalogue.join_roms(games, roms, 1).select(F.col("n_name").alias("game"), F.col("r_name").alias("dat"), F.col("n_nationkey").alias("rom"))


@query("""with g as (select n_nationkey as id, n_name as name, n_regionkey as data_file_id,
    case when n_nationkey % 2 = 1 then 'NATION_' || (n_nationkey - 1) when n_nationkey % 3 = 0 then 'nowhere' else first_value(n_name) over (partition by n_regionkey order by n_nationkey) end as clone_of from nation)
  select a.id, a.name, a.clone_of, b.id as parent_id from g a left join g b on a.data_file_id = b.data_file_id and a.clone_of = b.name""")
def parent_link(spark, sf):
    from pyspark.sql import Window as W

    n = t(spark, sf, "nation")
    first = F.first("n_name").over(W.partitionBy("n_regionkey").orderBy("n_nationkey"))
    clone = F.when(F.col("n_nationkey") % 2 == 1, F.concat(F.lit("NATION_"), F.col("n_nationkey") - 1)).when(F.col("n_nationkey") % 3 == 0, "nowhere").otherwise(first)
    games = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("data_file_id"), clone.alias("clone_of"))
    return catalogue.parent_links(games).select("id", "name", "clone_of", "parent_id")


@query("""with r as (select sha1(text) as sha1, min(doc_id) as rom_id from documents group by 1)
  select doc_id, sha1(replace(text, 'w', '')) as sha1, rom_id from documents left join r on sha1(replace(text, 'w', '')) = r.sha1""")
def associate_files(spark, sf):
    d = t(spark, sf, "documents")
    files = d.select("doc_id", F.sha1(F.replace("text", F.lit("w"), F.lit(""))).alias("sha1"))
    return catalogue.associate(files, d.select(F.col("doc_id").alias("id"), F.sha1("text").alias("sha1"))).select("doc_id", "sha1", "rom_id")


@query("select user_id, event_type, max(event_id) as event_id, arg_max(value, event_id) as value from events group by 1, 2")
def last_wins_upsert(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return catalogue.latest_by(e, ["user_id", "event_type"], "event_id")


@query("""select c_custkey as key, c_name as name from customer where c_custkey not in (select s_suppkey from supplier)
  union all select s_suppkey, s_name from supplier""")
def upsert_by_key(spark, sf):
    old = t(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    new = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return catalogue.upsert(old, new, ["key"])


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def delete_children(spark, sf):
    gone = t(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    return catalogue.without_children(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey", "c_custkey")


@query("select p_brand, p_name, count(*) as n from part group by 1, 2 having count(*) > 1")
def duplicate_entry_names(spark, sf):
    return catalogue.repeated_keys(t(spark, sf, "part"), ["p_brand", "p_name"])


# --- names and checks ------------------------------------------------------------------------------------------------

_SAFE = """not ({x} = '' or {x} in ('.', '..') or contains({x}, '/') or contains({x}, '\\') or regexp_matches({x}, '^[A-Za-z]:'))"""


@query(f"""with n as (select url as name from pages union all select regexp_extract(url, '[^/]*$') from pages union all select p_name from part
    union all select chr(65 + p_size) || ':' || p_name from part union all select '../' || p_name from part)
  select name, {_SAFE.format(x='name')} as file_ok,
    not (contains(name, '\\') or regexp_matches(name, '^[A-Za-z]:') or len(list_filter(string_split(name, '/'), lambda p: p in ('', '.', '..'))) > 0) as entry_ok from n""")
def name_safety(spark, sf):
    pages, part = t(spark, sf, "pages"), t(spark, sf, "part")
    names = pages.select(F.col("url").alias("name")).union(pages.select(F.regexp_extract("url", "[^/]*$", 0))).union(part.select("p_name"))
    names = names.union(part.select(F.concat(F.char(F.col("p_size") + 65), F.lit(":"), "p_name"))).union(part.select(F.concat(F.lit("../"), "p_name")))
    return names.select("name", paths.safe_file_name(F.col("name")).alias("file_ok"), paths.safe_entry_name(F.col("name")).alias("entry_ok"))


@query("select doc_id, strlen(text) as size, sha1(text) as sha1, md5(text) as md5, true as verified from documents")
def digest_checks(spark, sf):
    d = t(spark, sf, "documents")
    digest = F.lower(F.hex(text.checked_sha1(text.from_hex(F.sha1("text"), "sha1"), F.col("doc_id").cast("string"))))
    return d.select("doc_id", F.octet_length("text").cast("long").alias("size"), digest.alias("sha1"), F.md5("text").alias("md5"), text.verified_sha1(digest, F.upper(F.sha1("text"))).alias("verified"))


@query("""with p as (select doc_id, '/a.b/' || source || case doc_id % 5 when 0 then '.zip' when 1 then '.ZIP' when 2 then '.7z' when 3 then '' else '.tar.rar' end as path, doc_id % 2 = 0 as in_archive from documents)
  select doc_id, path, case when not in_archive then 'bare' when lower(path) like '%.zip' then 'zip' else 'archive' end as kind,
    regexp_extract(path, '[^/]*$') as name, regexp_extract(regexp_extract(path, '[^/]*$'), '^.+[.]([^.]*)$', 1) as ext from p""")
def source_kind_case(spark, sf):
    ending = F.element_at(F.array(*[F.lit(x) for x in (".zip", ".ZIP", ".7z", "", ".tar.rar")]), (F.col("doc_id") % 5 + 1).cast("int"))
    d = t(spark, sf, "documents").select("doc_id", F.concat(F.lit("/a.b/"), "source", ending).alias("path"))
    p = F.col("path")
    return d.select("doc_id", "path", paths.source_kind(F.col("doc_id") % 2 == 0, p).alias("kind"), paths.file_name(p).alias("name"), paths.extension(p).alias("ext"))


@query("""select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') as attribute,
  replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as body from documents""")
def xml_escape(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.xml_escape_attribute(F.col("text")).alias("attribute"), text.xml_escape_text(F.col("text")).alias("body"))


@query("select page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '\"'), '&#39;', '''') as plain from pages")
def html_unescape(spark, sf):
    return t(spark, sf, "pages").select("page_id", text.html_unescape(F.col("html")).alias("plain"))


@query("select page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') as safe from pages")
def safe_names(spark, sf):
    return t(spark, sf, "pages").select("page_id", text.safe_name(F.col("url")).alias("safe"))


@query("""with h as (select page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '[^A-Za-z0-9._-]+', '_', 'g') as host from pages),
  n as (select page_id, coalesce(nullif(substr(case page_id % 4 when 0 then repeat('long-name.', 9) when 1 then '' else host end, 1, 80), ''), 'rom') as base from h),
  o as (select *, row_number() over (partition by base order by page_id) as k from n)
  select page_id, case when k = 1 then base else substr(base, 1, 80 - length('_' || k)) || '_' || k end as unique_name from o""")
def unique_names(spark, sf):
    host = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), "[^A-Za-z0-9._-]+", "_")
    kind = F.col("page_id") % 4
    base = F.when(kind == 0, "long-name." * 9).when(kind == 1, "").otherwise(host)  # longer than a name may be, empty, and as they come
    return catalogue.unique_names(t(spark, sf, "pages"), base, ["page_id"]).select("page_id", "unique_name")


@query("select page_id, case when page_id = (select min(page_id) from pages) then 'one' else 'one_' || row_number() over (order by page_id) end as unique_name from pages")
def one_base_names(spark, sf):
    """All rows have one base; bases of over 100 rows are dealt out."""
    return catalogue.unique_names(t(spark, sf, "pages"), F.lit("one"), ["page_id"], hot=100).select("page_id", "unique_name")


@query("""with p as (select page_id, lag(page_id % 5) over (order by page_id = 3, page_id) as caller, page_id % 5 as callee from pages)
  select caller, callee, count(*) as n from p where caller is not null group by 1, 2""")
def one_instant_edges(spark, sf):
    """Edges of one thread whose rows have one time but for one; keys of over 100 rows are dealt out."""
    e = t(spark, sf, "pages").select(F.lit(1).alias("tid"), F.when(F.col("page_id") == 3, 9.0).otherwise(0.0).alias("time"), "page_id", (F.col("page_id") % 5).alias("f"))
    return profile.sequence_edges(e, "tid", ["time", "page_id"], "f", most=100).groupBy("caller", "callee").agg(F.count("*").alias("n"))


@query("""select doc_id, (lang in ('en') or (source in ('src1', 'src3') and contains(lower(text), 'th'))) as admitted,
  regexp_extract(source || '.' || lang, '^.+[.]([^.]*)$', 1) in ('en', 'de') as listed from documents""")
def catalog_filters(spark, sf):
    d = t(spark, sf, "documents")
    tier = F.when(F.col("source").isin("src1", "src3"), "curated").otherwise("metadata")
    signal = admission.contains_any(F.col("text"), ("th",))
    name = F.concat_ws(".", "source", "lang")
    return d.select("doc_id", admission.admitted(tier, F.col("lang") == "en", signal).alias("admitted"), paths.extension(name).isin("en", "de").alias("listed"))


@query("""with f as (select p_partkey, p_name || case p_partkey % 4 when 0 then '.NES' when 1 then '.zip' when 2 then '' else '.txt' end as name, p_size % 2 as ext0, p_size % 3 as excl from part)
  select p_partkey, name, lower(regexp_extract(name, '^.+[.]([^.]*)$', 1)) in ('bin','ch8','chip8','gb','gba','gbc','n64','nes','rom','sfc','smc','v64','z64')
     or (ext0 = 1 and not contains(name, '.')) as taken,
    excl = 1 and (contains(lower(name), 'sonic') or contains(lower(name), 'quake')) as excluded from f""")
def file_admission(spark, sf):
    ending = F.element_at(F.array(*[F.lit(x) for x in (".NES", ".zip", "", ".txt")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    f = t(spark, sf, "part").select("p_partkey", F.concat("p_name", ending).alias("name"), (F.col("p_size") % 2).alias("ext0"), (F.col("p_size") % 3).alias("excl"))
    return f.select("p_partkey", "name", admission.takes_file(F.col("name"), F.col("ext0")).alias("taken"), admission.excluded(F.lit("metadata"), F.col("excl"), F.col("name")).alias("excluded"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props(spark, sf):
    return t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select doc_id, source from (select *, row_number() over (order by source, doc_id) as k from documents) where k <= 128")
def global_cap(spark, sf):
    """The cap of the catalogue builder, in order of source and id: the limit is the feature."""
    return catalogue.capped(t(spark, sf, "documents").select("doc_id", "source"), ["source", "doc_id"], 128)


# --- profiles --------------------------------------------------------------------------------------------------------


def event_rows(spark, sf) -> DataFrame:
    e = t(spark, sf, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("event_id", us.alias("us"), F.col("user_id").alias("tid"), F.col("event_type").alias("comm"), F.col("event_type").alias("function"), "value")


@query("select user_id as tid, event_type as comm, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct from events group by 1, 2")
def thread_breakdown(spark, sf):
    return profile.thread_breakdown(event_rows(spark, sf)).withColumn("pct", F.round("pct", 6))


@query("""select function, n, pct from (select user_id % 100 || event_type as function, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct,
  row_number() over (order by count(*) desc, user_id % 100 || event_type) as k from events group by 1) where k <= 40""")
def top_functions(spark, sf):
    rows = event_rows(spark, sf).withColumn("function", F.concat(F.col("tid") % 100, "comm"))
    return profile.top_functions(rows, 40).withColumn("pct", F.round("pct", 6))


@query("""with c as (select user_id as tid, event_type as function, count(*) as n from events group by 1, 2),
  w as (select tid, sum(n) as thread_n from c group by 1),
  k as (select tid, thread_n from w order by thread_n desc, tid limit 8)
  select tid, cast(row_number() over (partition by tid order by n desc, function) as integer) as rank, function, n, round(100.0 * n / thread_n, 6) as pct from c join k using (tid)
  qualify rank <= 2""")
def top_functions_per_thread(spark, sf):
    rows = event_rows(spark, sf).withColumn("comm", F.lit("t"))
    return profile.top_functions_per_thread(rows, 2).drop("comm").withColumn("pct", F.round("pct", 6))


@query("""with p as (select lag(event_type) over (partition by user_id order by ts, event_id) as caller, event_type as callee from events)
  select caller, callee, count(*) as n from p where caller is not null group by 1, 2""")
def callee_edges(spark, sf):
    e = profile.sequence_edges(event_rows(spark, sf), "tid", ["us", "event_id"], "function")
    return e.groupBy("caller", "callee").agg(F.count("*").alias("n"))


@query("""with s as (select l_orderkey, list(l_returnflag || l_linestatus order by l_linenumber, l_returnflag || l_linestatus) as stack from lineitem group by 1),
  p as (select unnest(list_zip(stack[2:], stack[:-2])) as e from s where len(stack) > 1),
  c as (select e[1] as caller, e[2] as callee, count(*) as n from p group by 1, 2)
  select caller, callee, n, round(100.0 * n / (select count(*) from s), 6) as pct from c order by n desc, caller, callee limit 30""")
def stack_edges(spark, sf):
    li = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("f")))).alias("s"))
    return profile.callee_edges(li.select(F.transform("s", lambda x: x["f"]).alias("stack"))).withColumn("pct", F.round("pct", 6))


@query("""with b as (select epoch_us(ts) as us, event_type, min(epoch_us(ts)) over () as lo, max(epoch_us(ts)) over () as hi from events),
  k as (select cast(least((us - lo) * 10 // (hi - lo), 9) as integer) as bucket, event_type, count(*) as n from b group by 1, 2)
  select bucket, cast(sum(n) as bigint) as n, arg_min(event_type, (-n, event_type)) as mode from k group by 1""")
def timeline_buckets(spark, sf):
    return profile.timeline(event_rows(spark, sf), "us", "function", 10)


@query("""with b as (select epoch_us(ts) as us, event_type, min(epoch_us(ts)) over () as lo, max(epoch_us(ts)) over () as hi from events)
  select cast(least((us - lo) * 10 // (hi - lo), 9) as integer) as bucket, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'purchase') as purchase from b where event_type in ('click', 'purchase') group by 1""")
def timeline_pivot(spark, sf):
    return profile.timeline_by(event_rows(spark, sf), "us", "function", ["click", "purchase"], 10)


@query("select min(epoch_us(ts)) as first, max(epoch_us(ts)) as last, max(epoch_us(ts)) - min(epoch_us(ts)) as duration from events")
def time_range(spark, sf):
    return profile.time_range(event_rows(spark, sf), "us")


@query("select user_id as tid, arg_min(event_type, event_id) as comm from events group by 1")
def first_thread_names(spark, sf):
    return profile.first_names(event_rows(spark, sf), "event_id")


RULES = (Rule("Fastener", ("bolt", "nut", "screw")), Rule("Toy", ("widget", "gizmo")), Rule("Small", ("small", "red"), prefix=True))
_CASE = "case " + " ".join(
    f"when {' or '.join(f"starts_with({{x}}, '{n}')" if r.prefix else f"contains(lower({{x}}), '{n}')" for n in r.needles)} then '{r.label}'" for r in RULES
) + " else 'Other' end"


@query(f"select {_CASE.format(x='p_name')} as category, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct from part group by 1")
def category_counts(spark, sf):
    return profile.category_counts(t(spark, sf, "part"), "p_name", RULES).withColumn("pct", F.round("pct", 6))


def part_frames(spark, sf) -> DataFrame:
    """Parts as frames; percentages are hundredths of a price, as exact quotients."""
    return t(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("samples"), F.round(F.col("p_size") / 25.0, 2).alias("percent"), F.col("p_partkey").alias("seq"), "p_type")


_FRAMES = "with f as (select p_name as name, p_size as samples, round(p_size / 25.0, 2) as percent, p_partkey as seq, p_type from part) "


@query(_FRAMES + f"select {_CASE.format(x='name')} as category, round(sum(percent), 4) as percent, count(*) as n from f group by 1")
def category_percent_sum(spark, sf):
    return profile.category_percents(part_frames(spark, sf), RULES).withColumn("percent", F.round("percent", 4))


@query(_FRAMES + f"""select category, cast(rank as integer) as rank, name, percent from (select {_CASE.format(x='name')} as category, name, percent,
  row_number() over (partition by {_CASE.format(x='name')} order by percent desc, seq) as rank from f where percent >= 0.5) where rank <= 5""")
def category_top5(spark, sf):
    return profile.category_top(part_frames(spark, sf), rules=RULES).select("category", "rank", "name", "percent")


@query(_FRAMES + "select name, percent from f where percent >= 1.0 order by percent desc, seq limit 30")
def frame_top(spark, sf):
    return profile.frame_top(part_frames(spark, sf)).select("name", "percent")


@query(_FRAMES + "select name, percent from f where contains(lower(name), 'widget')")
def frame_search(spark, sf):
    return profile.frame_search(part_frames(spark, sf), "WIDGET").select("name", "percent")


@query("select event_type as syscall, count(*) as n, round(sum(value), 2) as percent from events group by 1")
def frame_syscalls(spark, sf):
    e = t(spark, sf, "events")
    prefix = F.when(F.col("event_id") % 2 == 0, "__x64_sys_").otherwise("__x86_sys_")
    f = profile.frame_syscalls(e.select(F.concat(prefix, "event_type").alias("name"), F.col("value").alias("percent")))
    return f.groupBy("syscall").agg(F.count("*").alias("n"), F.round(F.sum("percent"), 2).alias("percent"))


_DIFF = """with f as (select user_id % 50 || event_type as name, round(value, 2) as percent, event_id as seq, event_id % 3 = 0 as old from events),
  b as (select name, arg_min(percent, (percent, -seq)) as before, count(*) as nb from f where old group by 1),
  a as (select name, arg_min(percent, (percent, -seq)) as after, count(*) as na from f where not old group by 1),
  d as (select name, coalesce(before, 0.0) as before, coalesce(after, 0.0) as after, unnest(range(coalesce(nb, na))) as copy from b full join a using (name)),
  r as (select name, before, after, round(after - before, 2) as delta from d where abs(after - before) >= 0.01) """


def _sides(spark, sf):
    e = t(spark, sf, "events").select(F.concat(F.col("user_id") % 50, "event_type").alias("name"), F.round("value", 2).alias("percent"), F.col("event_id").alias("seq"))
    return e.filter(F.col("seq") % 3 == 0), e.filter(F.col("seq") % 3 != 0)


@query(_DIFF + "select * from r")
def frame_diff(spark, sf):
    return profile.frame_diff(*_sides(spark, sf)).withColumn("delta", F.round("delta", 2))


@query(_DIFF + "select round(sum(case when delta > 0 then delta else 0 end), 2) as regressions, round(sum(case when delta < 0 then delta else 0 end), 2) as improvements, count(*) as n from r")
def frame_diff_totals(spark, sf):
    out = profile.diff_totals(profile.frame_diff(*_sides(spark, sf)))
    return out.select(F.round("regressions", 2).alias("regressions"), F.round("improvements", 2).alias("improvements"), "n")


@query("""with x as (select l_orderkey, l_linenumber, l_returnflag || '(' || l_linestatus || ') &lt;a&gt; (' || format('{:,}', cast(floor(l_extendedprice) as bigint)) || ' samples, ' || l_quantity || '%)' as title from lineitem)
  select l_orderkey, l_linenumber, trim(replace(replace(regexp_extract(title, '^(.*)[(]', 1), '&lt;', '<'), '&gt;', '>')) as name,
    cast(replace(regexp_extract(title, '[(]([0-9,]+) sample', 1), ',', '') as bigint) as samples, cast(regexp_extract(title, ', ([0-9.]*)%', 1) as double) as percent from x""")
def title_parse(spark, sf):
    li = t(spark, sf, "lineitem")
    title = F.concat("l_returnflag", F.lit("("), "l_linestatus", F.lit(") &lt;a&gt; ("), F.format_number(F.floor("l_extendedprice").cast("long"), 0), F.lit(" samples, "), F.col("l_quantity").cast("string"), F.lit("%)"))
    x = li.select("l_orderkey", "l_linenumber", title.alias("t"))
    return x.select("l_orderkey", "l_linenumber", text.title_name(F.col("t")).alias("name"), text.title_samples(F.col("t")).alias("samples"), text.title_percent(F.col("t")).alias("percent"))


@query("""select event_id, event_type as comm, user_id as tid, event_id / 4.0 as time, 'do_' || event_type || '<x>' as function from events""")
def perf_parse(spark, sf):
    e = t(spark, sf, "events")
    h = F.concat("event_type", F.lit(" 17/"), "user_id", F.lit(" [003] "), (F.col("event_id") / 4.0).cast("decimal(18,2)"), F.lit(": cycles:"))
    f = F.concat(F.lit("\t ffffabc0 do_"), "event_type", F.lit("<x>+0x1f (/usr/lib/a (b).so)"))
    x = e.select("event_id", h.alias("h"), f.alias("f"))
    return x.select("event_id", text.header_comm(F.col("h")).alias("comm"), text.header_tid(F.col("h")).alias("tid"), text.header_time(F.col("h")).alias("time"), text.frame_function(F.col("f")).alias("function"))


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages where contains(html, '<title>')")
def html_titles(spark, sf):
    p = t(spark, sf, "pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<title>([^<]*)</title>"), F.lit(1))).alias("title"))


@query("select round(avg(l_quantity), 6) as mean, round(stddev_samp(l_quantity), 6) as stddev, min(l_quantity) as min, max(l_quantity) as max from lineitem")
def run_stats(spark, sf):
    s = profile.run_stats(t(spark, sf, "lineitem"), "l_quantity")
    return s.select(F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"), "min", "max")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in (Q | file_queries.Q).items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (Q | file_queries.Q).items() if sql}
