"""All queries of the library over the shared tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, geometry, text
from ..operators import audio, dicom, documents, paths, state, tabular, vision
from ..streaming.incremental import windowed_counts

DAYS = 400
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Redaction of documents ------------------------------------------------

_MASKED = "array_to_string(list_transform(string_split(regexp_replace({t}, '({p})', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x, i: case when i % 2 = 0 then repeat('*', length(x)) else x end), '')"


def _masked(pattern: str, t: str = "text") -> str:
    return _MASKED.format(t=t, p=pattern)


def _redaction(kind: str) -> None:
    def run(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text"), text.RULES[kind]).alias("text"))

    run.__name__ = f"redact_{kind}"
    query(f"select doc_id, {_masked(text.RULES[kind])} as text from documents")(run)


for _kind in text.RULES:
    _redaction(_kind)


@query(
    f"""with h as (select source, text, regexp_extract_all(text, '({text.ANY_RULE})', 1) as hits, {_masked(text.ANY_RULE)} as red from documents)
select source, count(*) as n_docs, count(*) filter (where len(hits) > 0) as n_docs_hit, cast(sum(len(hits)) as bigint) as n_hits,
  cast(sum(len(regexp_extract_all(red, '({text.ANY_RULE})', 1))) as bigint) as n_residual, cast(sum(length(red)) as bigint) as n_chars
from h group by source"""
)
def redaction_report(spark, sf_dir):
    """Personal data found, masked and left, by source."""
    docs = table(spark, sf_dir, "documents")
    r = docs.select("source", F.size(text.hits(F.col("text"))).alias("h"), text.redact(F.col("text")).alias("red"))
    return r.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.count_if(F.col("h") > 0).alias("n_docs_hit"), F.sum("h").cast("long").alias("n_hits"),
        F.sum(F.size(text.hits(F.col("red")))).cast("long").alias("n_residual"), F.sum(F.length("red")).cast("long").alias("n_chars"),
    )


@query(
    "select lang, kind, cast(sum(n) as bigint) as n_hits, count(*) filter (where n > 0) as n_docs from ("
    + " union all ".join(f"select lang, '{k}' as kind, len(regexp_extract_all(text, '{p}')) as n from documents" for k, p in text.RULES.items())
    + ") group by lang, kind"
)
def pii_hits_by_lang_category(spark, sf_dir):
    """One scan; the kinds are exploded from counts rather than from texts."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.size(text.hits(F.col("text"), p)).alias("n")) for k, p in text.RULES.items()])
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(each).alias("x")).select("lang", "x.*")
    return rows.groupBy("lang", "kind").agg(F.sum("n").cast("long").alias("n_hits"), F.count_if(F.col("n") > 0).alias("n_docs"))


@query(
    f"""with p as (select doc_id, text, unnest(list_distinct(regexp_extract_all(text, '({text.RULES["email"]})', 1))) as found from documents)
select doc_id, found, cast((length(text) - length(replace(text, found, ''))) / length(found) as bigint) as n from p"""
)
def count_occurrences(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array_distinct(text.hits(F.col("text"), text.RULES["email"]))).alias("found"))
    return found.select("doc_id", "found", text.occurrences(F.col("text"), F.col("found")).alias("n"))


@query(
    f"""select doc_id, list_reduce(list_prepend(text, list_sort(list_distinct(regexp_extract_all(text, '({text.RULES["card"]})', 1)))),
  lambda a, x: replace(a, x, repeat('*', length(x)))) as text from documents"""
)
def redact_literals(spark, sf_dir):
    """Found texts starred wherever they occur in their document."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.redact_literals(t, text.hits(t, text.RULES["card"])).alias("text"))


@query()
def verify_fixpoint(spark, sf_dir):
    """Documents through detection, whole-document application and bounded checks."""
    out = documents.deidentify(table(spark, sf_dir, "documents").select("doc_id", "text"), DAYS)
    return out.select("doc_id", "text", "_status")


@query(
    """with recursive c as (
  select doc_id, text, length(text) as len, 0 as chunk_no, 0 as start, 0 as stop, false as done from documents where length(text) > 0
  union all
  select doc_id, text, len, chunk_no + 1, nstart, nstop, nstop >= len from (
    select *, case when hard >= len then len
      when para > 0 then plo + para - 1 when sent > 0 then slo + sent else hard end as nstop from (
      select *, least(nstart + 8000, len) as hard, nstart + 7500 as plo, nstart + 7800 as slo,
        case when contains(substr(text, nstart + 7501, 500), chr(10) || chr(10)) then 500 - strpos(reverse(substr(text, nstart + 7501, 500)), chr(10) || chr(10)) end as para,
        case when contains(substr(text, nstart + 7801, 200), '. ') then 200 - strpos(reverse(substr(text, nstart + 7801, 200)), ' .') end as sent
      from (select *, case when chunk_no = 0 and stop = 0 then 0 else greatest(stop - 500, start + 1) end as nstart from c where not done))))
select doc_id, cast(chunk_no - 1 as integer) as chunk_no, cast(start as integer) as start, substr(text, start + 1, stop - start) as chunk from c where chunk_no > 0"""
)
def chunk_documents(spark, sf_dir):
    return documents.chunks(table(spark, sf_dir, "documents"))


# --- Dates -----------------------------------------------------------------

#: name: Spark's spelling of the input, DuckDB's, the formats it is read by there.
_SPELLINGS = {
    "iso": ("yyyy-MM-dd", "%Y-%m-%d", ["%Y-%m-%d"]),
    "eu": ("dd.MM.yyyy", "%d.%m.%Y", ["%d.%m.%Y"]),
    "us": ("MM/dd/yyyy", "%m/%d/%Y", ["%d/%m/%Y", "%m/%d/%Y"]),
    "monthname": ("MMMM dd, yyyy", "%B %d, %Y", ["%B %d, %Y"]),
    "shortmonth": ("dd MMM yyyy", "%d %b %Y", ["%d %B %Y", "%d %b %Y"]),
}


def _spelling(name: str, spark_format: str, duck_format: str, reads: list[str]) -> None:
    def run(spark, sf_dir):
        o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", spark_format).alias("original"))
        return o.select("o_orderkey", "original", dates.shift(F.col("original"), DAYS).alias("shifted"))

    run.__name__ = f"date_shift_{name}"
    tries = ", ".join(f"strftime(try_strptime(original, '{r}') + interval {DAYS} day, '{r}')" for r in reads)
    query(f"select o_orderkey, original, coalesce({tries}) as shifted from (select o_orderkey, strftime(o_orderdate, '{duck_format}') as original from orders)")(run)


for _name, _args in _SPELLINGS.items():
    _spelling(_name, *_args)


@query(
    f"""select event_id, strftime(ts, '%Y-%m-%d %I:%M %p') as original, strftime(date_trunc('minute', ts) + interval {DAYS} day, '%Y-%m-%d %I:%M %p') as shifted,
  strftime(ts - interval 500 day, '%Y-%m-%dT%H:%M:%S') as shifted_back from events"""
)
def date_shift_ampm(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd hh:mm a").alias("original"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))
    return e.select("event_id", "original", dates.shift(F.col("original"), DAYS).alias("shifted"), dates.shift(F.col("iso"), -500).alias("shifted_back"))


@query(
    """select o_orderkey, strftime(o_orderdate, '%Y') as y, cast(year(o_orderdate) + floor(d / 365.0) as integer)::varchar as shifted,
  cast(year(o_orderdate) + floor(d / 365.0) as integer)::varchar || ' - ' || cast(year(o_orderdate) + 2 + floor(d / 365.0) as integer)::varchar as shifted_range
from (select *, cast(o_orderkey % 2001 - 1000 as integer) as d from orders)"""
)
def date_shift_years(spark, sf_dir):
    """Years and ranges of years, by offsets of either sign."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("n"), (F.col("o_orderkey") % 2001 - 1000).cast("int").alias("d"))
    y = F.col("n").cast("string")
    span = F.concat(y, F.lit(" - "), (F.col("n") + 2).cast("string"))
    return o.select("o_orderkey", y.alias("y"), dates.shift(y, F.col("d")).alias("shifted"), dates.shift(span, F.col("d")).alias("shifted_range"))


@query(
    f"""select p_partkey, original, coalesce(strftime(try_strptime(original, '%Y-%m-%d') + interval {DAYS} day, '%Y-%m-%d'), original) as shifted
from (select p_partkey, printf('20%02d-%02d-%02d', p_size, p_size % 14, p_size % 33) as original from part)"""
)
def date_shift_invalid_kept(spark, sf_dir):
    """Dates that don't exist stay as they are."""
    n = F.col("p_size")
    p = table(spark, sf_dir, "part").select("p_partkey", F.format_string("20%02d-%02d-%02d", n, n % 14, n % 33).alias("original"))
    return p.select("p_partkey", "original", F.coalesce(dates.shift(F.col("original"), DAYS), F.col("original")).alias("shifted"))


_RENDERED = "text || ' seen ' || strftime({d}, '%Y-%m-%d') || ', ' || strftime({d} + interval 400 day, '%d.%m.%Y') || ' and ' || strftime({d} + interval 1 day, '%B %d, %Y') || '; id12140-09-25 _2140-09-25'"
_DAY = "(date '2100-01-01' + cast(n_chars % 20000 as integer))"


def _dated(spark, sf_dir) -> DataFrame:
    """Whole documents with dates in three spellings, the second of which is what
    the first becomes."""
    d = F.date_add(F.lit("2100-01-01").cast("date"), (F.col("n_chars") % 20000).cast("int"))
    parts = [F.col("text"), F.lit(" seen "), F.date_format(d, "yyyy-MM-dd"), F.lit(", "), F.date_format(F.date_add(d, 400), "dd.MM.yyyy"), F.lit(" and "), F.date_format(F.date_add(d, 1), "MMMM dd, yyyy"), F.lit("; id12140-09-25 _2140-09-25")]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(*parts).alias("text"))


@query(f"select doc_id, {_RENDERED.format(d=f'({_DAY} + interval {DAYS} day)')} as text from documents")
def date_shift_text(spark, sf_dir):
    """All dates of a text in one pass; none moves twice."""
    return _dated(spark, sf_dir).select("doc_id", dates.shift_text(F.col("text"), DAYS).alias("text"))


@query(f"select doc_id, unnest([strftime({_DAY}, '%Y-%m-%d'), strftime({_DAY} + interval 400 day, '%d.%m.%Y'), strftime({_DAY} + interval 1 day, '%B %d, %Y')]) as found from documents")
def find_date_tokens(spark, sf_dir):
    return _dated(spark, sf_dir).select("doc_id", F.explode(dates.found(F.col("text"))).alias("found"))


_OFFSET = "cast((365 + ('0x' || substr(sha256({k}), 1, 8))::bigint % 731) * case when ('0x' || substr(sha256({k}), 9, 1))::bigint % 2 = 0 then 1 else -1 end as integer)"


@query(f"select c_custkey, {_OFFSET.format(k='c_name')} as offset_days from customer")
def patient_offset(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", dates.subject_offset(F.col("c_name")).alias("offset_days"))


def _moved_dates(spark, sf_dir) -> DataFrame:
    """Dates of orders and of their items, each before and after it moved by its
    customer's offset, which is found once an order."""
    iso = "yyyy-M-d"
    moved = lambda c: F.to_date(dates.shift(F.date_format(c, "yyyy-MM-dd"), F.col("off"), iso))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", dates.subject_offset(F.col("o_custkey").cast("string")).alias("off"))
    o = o.withColumn("ordered_to", moved("o_orderdate"))
    both = o.join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    return both.withColumn("shipped_to", moved("l_shipdate"))


@query(
    f"""with x as (select o_custkey, o_orderdate + cast({_OFFSET.format(k="cast(o_custkey as varchar)")} as int) * interval 1 day as o, l_shipdate + cast({_OFFSET.format(k="cast(o_custkey as varchar)")} as int) * interval 1 day as s from orders join lineitem on o_orderkey = l_orderkey)
select o_custkey, cast(min(o) as date) as first_order, cast(max(s) as date) as last_shipped, count(distinct cast(o as date)) as n_days from x group by 1"""
)
def patient_moved_span(spark, sf_dir):
    """The span of every subject's dates after all have moved."""
    return _moved_dates(spark, sf_dir).groupBy("o_custkey").agg(F.min("ordered_to").alias("first_order"), F.max("shipped_to").alias("last_shipped"), F.countDistinct("ordered_to").alias("n_days"))


@query("select o_custkey, count(*) as n, count(*) as n_same from orders join lineitem on o_orderkey = l_orderkey group by o_custkey")
def patient_interval_preserved(spark, sf_dir):
    """Days between a subject's dates are the same after both have moved."""
    both = _moved_dates(spark, sf_dir)
    same = F.datediff("shipped_to", "ordered_to") == F.datediff("l_shipdate", "o_orderdate")
    return both.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(same).alias("n_same"))


# --- Tables ----------------------------------------------------------------


def _customers(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select((F.col("c_custkey") - 1).alias("_row_index"), "c_name", F.col("c_nationkey").cast("string").alias("c_nationkey"), "c_mktsegment")


@query("select c_custkey, case when c_name <> '' then repeat('*', length(c_name)) else c_name end as c_name, c_mktsegment from customer")
def mask_column_customer(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.mask(F.col("c_name")).alias("c_name"), "c_mktsegment")


@query("select c as \"column\" from (values ('c_name')) t(c)")
def pii_column_candidates(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in tabular.identifier_columns(_customers(spark, sf_dir))], "`column` string")


@query("select c_custkey - 1 as _row_index, repeat('*', length(c_name)) as c_name, cast(c_nationkey as varchar) as c_nationkey, c_mktsegment, 'clean' as _status from customer")
def table_deidentify(spark, sf_dir):
    """The three phases over a table, with its status."""
    return tabular.deidentify(_customers(spark, sf_dir), DAYS).table.drop("_failed")


@query("select cast(rn // 15 as bigint) as batch, count(*) as n, min(o_orderkey) as first_key, max(rn) as last_row from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as rn from orders) group by 1")
def row_batches_15(spark, sf_dir):
    """Gapless row numbers by an order, in batches of 15."""
    o = tabular.with_index(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return o.groupBy(tabular.batch_no().alias("batch")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("_row_index").alias("last_row"))


@query(
    "select c_custkey - 1 as row_index, printf('=== ROW %d ===', c_custkey - 1) || chr(10) || 'c_name: ' || c_name || chr(10) || 'c_nationkey: ' || c_nationkey || chr(10) || 'c_mktsegment: ' || c_mktsegment as rendered from customer"
)
def row_render(spark, sf_dir):
    c = _customers(spark, sf_dir)
    return c.select(F.col("_row_index").alias("row_index"), tabular.rendered(c).alias("rendered"))


@query(
    """select c_custkey - 1 as row_index, col as "column", case when o = n then 'UNCHANGED' else 'CHANGED' end as state, o as original, n as anonymised
from customer, lateral (values ('c_name', c_name, repeat('*', length(c_name))), ('c_nationkey', cast(c_nationkey as varchar), cast(c_nationkey as varchar)), ('c_mktsegment', c_mktsegment, c_mktsegment)) v(col, o, n)"""
)
def positional_join_diff(spark, sf_dir):
    """Originals beside results, by row number."""
    c = _customers(spark, sf_dir)
    return tabular.differences(c, tabular.mask_columns(c, ["c_name"]))


@query(
    f"select event_id as row_index, 'seen' as \"column\", original, shifted from (select event_id, strftime(ts, '%Y-%m-%d') as original, strftime(ts + interval {DAYS} day, '%Y-%m-%d') as shifted from events)"
)
def date_log(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("_row_index"), F.date_format("ts", "yyyy-MM-dd").alias("seen"))
    return tabular.date_log(e, DAYS)


# --- Files, names and state -------------------------------------------------

_PATHS = "source || '/' || lang || '/note_' || doc_id || case doc_id % 5 when 0 then '.txt' when 1 then '.csv' when 2 then '.DCM' when 3 then '.png' else '' end"


def _paths(spark, sf_dir) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in (".txt", ".csv", ".DCM", ".png", "")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/note_"), F.col("doc_id").cast("string"), kind).alias("path"))


@query(f"select doc_id, path, case doc_id % 5 when 0 then 'text' when 1 then 'csv' when 2 then 'dicom' when 3 then 'image' end as kind from (select doc_id, {_PATHS} as path from documents)")
def ext_route(spark, sf_dir):
    return _paths(spark, sf_dir).select("doc_id", "path", text.route(F.col("path")).alias("kind"))


@query("select page_id, path from (select page_id, split_part(url, '://', 2) || case page_id % 4 when 0 then '/.git/x' when 1 then '/Thumbs.db' else '/a.txt' end as path from pages) where page_id % 4 > 1")
def ignore_hidden_filter(spark, sf_dir):
    tail = F.when(F.col("page_id") % 4 == 0, "/.git/x").when(F.col("page_id") % 4 == 1, "/Thumbs.db").otherwise("/a.txt")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.element_at(F.split("url", "://"), 2), tail).alias("path"))
    return p.where(~text.is_hidden(F.col("path")) & ~text.is_system_file(F.col("path")))


@query(
    """select folder, name, base, cast(row_number() over (partition by folder, base order by name) as integer) as counter,
  'note_ID' || printf('_%04d', row_number() over (partition by folder, base order by name)) || '.txt' as alias
from (select source || '/' || lang as folder, printf('note_%08d.txt', doc_id + 99000000) as name, 'note_ID.txt' as base from documents)"""
)
def file_seq_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return paths.alias_files(d.select(F.concat("source", F.lit("/"), "lang").alias("folder"), F.format_string("note_%08d.txt", F.col("doc_id") + 99000000).alias("name")))


def _known_folders(spark) -> DataFrame:
    return spark.createDataFrame([("patient_99000007", "patient_ID", 41, "patient_ID_041")], "folder string, base string, counter int, alias string")


@query(
    """select folder, base, cast(counter as integer) as counter, 'patient_ID' || printf('_%03d', counter) as alias from (
  select folder, 'patient_ID' as base, 41 + row_number() over (order by folder) as counter from (select distinct printf('patient_%08d', c_nationkey + 99000000) as folder from customer) where folder <> 'patient_99000007'
  union all select 'patient_99000007', 'patient_ID', 41)"""
)
def folder_seq_resume(spark, sf_dir):
    """Folder aliases that go on from the largest known counter."""
    c = table(spark, sf_dir, "customer").select(F.format_string("patient_%08d/visit.txt", F.col("c_nationkey") + 99000000).alias("path"))
    return paths.alias_folders(c, _known_folders(spark))


@query("select doc_id, 'S_' || replace(source, 'src', '') || '/' || case lang when 'en' then 'L1' when 'de' then 'L2' else lang end || '/x' as path from documents")
def path_alias_rewrite(spark, sf_dir):
    names = [(f"src{i}", f"S_{i}") for i in range(100)] + [("en", "L1"), ("de", "L2")]
    m = F.create_map(*[F.lit(x) for pair in names for x in pair])
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.substitute_parts(F.concat("source", F.lit("/"), "lang", F.lit("/x")), m).alias("path"))


@query(
    f"""select doc_id::varchar as original, 'doc_' || doc_id as anonymized, array_to_string(h, '; ') as phi_values, array_to_string(list_transform(h, lambda x: 'email'), '; ') as phi_categories
from (select doc_id, regexp_extract_all(text, '({text.RULES["email"]})', 1) as h from documents)"""
)
def mapping_export(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("original"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("alias"),
        F.transform(text.hits(F.col("text"), text.RULES["email"]), lambda x: F.struct(x.alias("value"), F.lit("email").alias("category"))).alias("found"),
    )
    return paths.mapping_table(d, "original", "found")


def _state(spark, sf_dir) -> DataFrame:
    """A state table: labelled documents were done; those of quality 0 failed, and
    for toxic ones the content has changed since."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id")
    h = F.when(F.col("toxic") == 1, F.lit("old")).otherwise(F.sha2("text", 256))
    return j.select(
        F.col("doc_id").cast("string").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"), F.lit("out").alias("output_path"), F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"),
        h.alias("hash"), F.when(F.col("quality") == 0, F.when(F.col("toxic") == 1, "Error 429").otherwise("bad file")).alias("error"), ((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("is_retryable"), F.lit(0).alias("retries_attempted"),
    )


@query("select cast(d.doc_id as varchar) as path, sha256(text) as hash from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and quality = 1 and toxic = 0)")
def tracker_anti_join(spark, sf_dir):
    """Files that are new, failed before or changed since."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash"))
    return state.pending(files, _state(spark, sf_dir))


@query("select count(*) as total, count(*) filter (where quality = 1) as completed, count(*) filter (where quality = 0) as failed, count(*) filter (where quality = 0 and toxic = 1) as retryable from documents join labels using (doc_id)")
def tracker_stats(spark, sf_dir):
    return state.stats(_state(spark, sf_dir))


@query(
    """select path, status, hash from (select cast(doc_id as varchar) as path, 'completed' as status, sha256(text) as hash from documents)"""
)
def tracker_upsert(spark, sf_dir):
    """The state after everything pending was processed."""
    s = _state(spark, sf_dir)
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash"))
    done = state.pending(files, s).select(F.col("path").alias("input_path"), F.lit("out").alias("output_path"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"), "hash", F.lit(1).alias("retries_attempted"))
    return state.upsert(s, state.from_results(done)).select("path", "status", "hash")


@query(
    """select event_id, error, regexp_matches(lower(error), '429|timeout|connection') as is_retryable from (select event_id,
  case event_id % 4 when 0 then 'HTTP 429: Rate Limit' when 1 then 'file is damaged' when 2 then 'read TIMEOUT' else 'Connection reset' end as error from events)"""
)
def retry_classify(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("HTTP 429: Rate Limit", "file is damaged", "read TIMEOUT", "Connection reset")])
    e = table(spark, sf_dir, "events").select("event_id", F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("error"))
    return e.select("event_id", "error", text.is_retryable(F.col("error")).alias("is_retryable"))


@query("select range as attempt, least(2.0 * pow(2.0, range - 1), 60.0)::double as seconds from range(1, 9)")
def backoff_delays(spark, sf_dir):
    return spark.range(1, 9).select(F.col("id").alias("attempt"), text.backoff(F.col("id")).alias("seconds"))


@query(
    """select input_path, success, retries_attempted from (select cast(event_id as varchar) as input_path, event_id % 3 < 2 as success, cast(case when event_id % 3 = 1 then 1 else 0 end as integer) as retries_attempted from events)"""
)
def retry_rounds(spark, sf_dir):
    """Failures that can pass are tried again; others are not."""
    files = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"))
    calls = []

    def process(todo: DataFrame) -> DataFrame:
        calls.append(1)
        m, again = F.col("path").cast("long") % 3, len(calls) > 1
        ok = (m == 0) | (F.lit(again) & (m == 1))
        return todo.select(F.col("path").alias("input_path"), ok.alias("success"), F.when(~ok, F.when(m == 1, "503").otherwise("damaged")).alias("error"), F.lit(len(calls) - 1).alias("retries_attempted"))

    return state.rounds(files, process).select("input_path", "success", "retries_attempted")


@query("select event_type = 'click' as success, count(*) as n, avg(value) as avg_time from events group by 1")
def run_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return state.summary(e.select((F.col("event_type") == "click").alias("success"), F.col("value").alias("processing_time")))


# --- Model answers ----------------------------------------------------------


@query("select conv_id, turn, trim(text) as answer from conversations")
def think_strip(spark, sf_dir):
    wrapped = F.concat(F.lit("<think>yes\nno</think> "), F.col("text"), F.lit(" <THINK>{}</THINK>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.strip_thinking(wrapped).alias("answer"))


@query("select conv_id, turn, role, cast(length(text) as integer) as n from conversations")
def json_extract_llm(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    noise = F.concat(F.lit("Sure:\n<think>{</think>```json\n"), F.to_json(F.struct("role", F.length("text").alias("n"))), F.lit("\u0001\n``` done"))
    got = F.from_json(text.json_object(noise), "role string, n int")
    return c.select("conv_id", "turn", got.alias("j")).select("conv_id", "turn", "j.*")


@query("select conv_id, turn, turn % 3 = 1 as answer from conversations")
def last_yes_no(spark, sf_dir):
    said = F.element_at(F.array(F.lit("Yes or no? NO."), F.lit("no... <think>no</think> Yes"), F.lit("unsure")), (F.col("turn") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.last_yes_no(said).alias("answer"))


# --- Geometry, images, tags, sound ------------------------------------------


def _boxes(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    n = lambda c, k: (F.col(c) % k).cast("int")
    a = geometry.box(n("l_partkey", 500), n("l_suppkey", 300), n("l_quantity", 50), n("l_linenumber", 7))
    b = geometry.box(n("l_suppkey", 500), n("l_partkey", 300), F.lit(40), F.lit(60))
    return li.select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"))


_BOXES = """(select l_orderkey, l_linenumber, cast(l_partkey % 500 as integer) ax, cast(l_suppkey % 300 as integer) ay, cast(cast(l_quantity as integer) % 50 as integer) aw, cast(l_linenumber % 7 as integer) ah,
  cast(l_suppkey % 500 as integer) bx, cast(l_partkey % 300 as integer) as by_, 40 bw, 60 bh from lineitem)"""


@query(f"select l_orderkey, l_linenumber, greatest(0, ax - 5) as x, greatest(0, ay - 5) as y, greatest(0, least(520, ax + aw + 5) - greatest(0, ax - 5)) as width, greatest(0, least(310, ay + ah + 5) - greatest(0, ay - 5)) as height from {_BOXES}")
def bbox_pad_clip(spark, sf_dir):
    p = geometry.pad_clip(F.col("a"), 5, F.lit(520), F.lit(310))
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", p.alias("p")).select("l_orderkey", "l_linenumber", "p.*")


@query(
    f"""select l_orderkey, l_linenumber, case when u > 0 then i / u else 0.0 end as iou from (select *, aw::double * ah + bw::double * bh - i as u from (
  select *, greatest(least(ax + aw, bx + bw) - greatest(ax, bx), 0)::double * greatest(least(ay + ah, by_ + bh) - greatest(ay, by_), 0) as i from {_BOXES}))"""
)
def bbox_iou(spark, sf_dir):
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", geometry.iou(F.col("a"), F.col("b")).alias("iou"))


@query("select p_partkey, least(1.0::double, 1024.0::double / w, 1024.0::double / h) as scale from (select p_partkey, p_size * 70 as w, p_partkey % 3000 + 1 as h from part)")
def bbox_scale(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", geometry.fit_scale(F.col("p_size") * 70, F.col("p_partkey") % 3000 + 1).alias("scale"))


@query(
    """select n_nationkey as image, size_no, x as wx, y as wy, least(ww, width - x) as cw, least(wh, height - y) as ch
from (select n_nationkey, 200 + 37 * n_nationkey as width, 90 + 11 * n_nationkey as height from nation), (values (0, 384, 96), (1, 384, 128), (2, 256, 64)) s(size_no, ww, wh),
  lateral (select unnest(range(0, width, ww // 2))::integer as x), lateral (select unnest(range(0, height, wh // 2))::integer as y)
where least(ww, width - x) >= 32 and least(wh, height - y) >= 16"""
)
def window_grid(spark, sf_dir):
    n = F.col("n_nationkey")
    images = table(spark, sf_dir, "nation").select(n.alias("image"), (200 + 37 * n).alias("width"), (90 + 11 * n).alias("height"))
    return geometry.window_grid(images).drop("width", "height")


def _readings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Benchmark passages as pages: their words as readings, every third as what
    is looked for."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("file"), F.lit(0).alias("page"), F.posexplode(F.split("text", r"\s+")).alias("n", "text"))
    box = [F.lit(k).alias(c) for c, k in (("y", 0), ("width", 90), ("height", 20))]
    ocr = b.select("file", "page", F.col("n").alias("ocr_idx"), "text", (F.col("n") * 100).alias("x"), *box, (1 / (1 + F.col("n"))).alias("confidence"))
    return b.where("n % 3 = 1").select("file", "page", F.col("n").alias("pii_idx"), "text", F.lit("name").alias("type")), ocr


@query(
    """with w as (select item_id, unnest(regexp_split_to_array(text, '\\s+')) as text, unnest(range(len(regexp_split_to_array(text, '\\s+')))) as n from benchmark),
m as (select p.item_id, p.n, p.text, o.n as ocr_idx, o.text as seen, row_number() over (partition by p.item_id, p.n order by o.n) as k from w p join w o on p.item_id = o.item_id
  and (contains(lower(p.text), lower(o.text)) or contains(lower(o.text), lower(p.text))) where p.n % 3 = 1)
select cast(item_id as varchar) as file, cast(n as integer) as pii_idx, text, cast(ocr_idx as integer) as ocr_idx, seen from m where k = 1"""
)
def match_exact_substring(spark, sf_dir):
    pii, ocr = _readings(spark, sf_dir)
    return vision.first_holding(pii, ocr).select("file", "pii_idx", "text", "ocr_idx", "seen")


@query()
def match_remaining(spark, sf_dir):
    # Printed readings lack every second word, handwritten ones lack a letter.
    pii, ocr = _readings(spark, sf_dir)
    return vision.match_remaining(pii, ocr.where("ocr_idx % 2 = 0"), ocr.withColumn("text", F.expr("substring(text, 2)")).withColumn("confidence", F.lit(0.5)))[0]


@query()
def match_fuzzy_greedy(spark, sf_dir):
    pii, ocr = _readings(spark, sf_dir)
    return vision.match_pages(pii, ocr)


@query()
def nms_dedup(spark, sf_dir):
    _, ocr = _readings(spark, sf_dir)
    twice = ocr.unionByName(ocr.withColumn("x", F.col("x") + 20).withColumn("confidence", F.col("confidence") / 2))
    return vision.dedup_readings(twice)


@query(
    """select doc_id, '' as PatientName, strftime(date '2140-09-25' + interval 400 day, '%Y%m%d') as StudyDate, 'bad' as SeriesDate, 'CT' as Modality, repeat('*', 16) as ImageComments from documents"""
)
def dicom_policy(spark, sf_dir):
    tags = {"PatientName": F.concat(F.lit("P^"), "source"), "StudyDate": F.lit("21400925"), "SeriesDate": F.lit("bad"), "Modality": F.lit("CT"), "ImageComments": F.lit("4111111111111111"), "StudyInstanceUID": F.concat(F.lit("1.2."), F.col("source"))}
    m = F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), v)])
    d = table(spark, sf_dir, "documents").select("doc_id", dicom.anonymise_tags(m, DAYS).alias("t"))
    return d.select("doc_id", *[F.col("t")[k].alias(k) for k in tags if k != "StudyInstanceUID"])


@query(
    f"""with p as (select doc_id, string_split(regexp_replace(regexp_replace({_masked(text.ANY_RULE)}, '(\\*{{2,}})', chr(1) || '\\1' || chr(1), 'g'), '^$', ''), chr(1)) as ps from documents)
select doc_id, count(*) filter (where regexp_full_match(trim(x), '\\*{{2,}}')) as n_beeps, count(*) filter (where trim(x) <> '' and not regexp_full_match(trim(x), '\\*{{2,}}')) as n_spoken from (select doc_id, unnest(ps) as x from p) group by doc_id"""
)
def beep_plan(spark, sf_dir):
    """Redacted texts as what would be spoken and beeped."""
    p = table(spark, sf_dir, "documents").select("doc_id", audio.plan(text.redact(F.col("text"))).alias("p"))
    n = lambda k: F.size(F.filter("p", lambda x: x["kind"] == k)).cast("long")
    return p.select("doc_id", n("beep").alias("n_beeps"), n("speech").alias("n_spoken"))


@query("select date_trunc('day', ts) as window_start, event_type, count(*) as n, sum(value) as total from events group by 1, 2")
def event_windows(spark, sf_dir):
    """Tumbling windows; an extension, used by streams."""
    return windowed_counts(table(spark, sf_dir, "events"))




from . import files_catalog  # noqa: E402, F401  (adds its queries)
