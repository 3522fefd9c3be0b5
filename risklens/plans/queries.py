"""One registered query per operator, over whole tables of the given folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.functions import errors, severity as sev, text
from risklens.operators import (
    attempts as att, filters, graph, imports, publish, reports, rules, scoring, tree, units, verdicts,
)
from risklens.operators.ordering import group_position
from risklens.plans import views as V
from risklens.session import materialize, new_path, tune
from risklens.sources import corpus, documents, sessions
from risklens.streaming import graph_index, index as index_stream, progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

F_COLS = ["project_name", "file", "function", "start_line", "risk_score", "type"]


def query(fn: Query) -> Query:
    """Register a query under the function's name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# ---------------------------------------------------------------- sources, sinks


@query
def src_corpus(spark, d):
    path = new_path(spark, "corpus")
    lines = V.files(spark, d).select("content", F.regexp_extract("file_path", r"(pkg\d+)/", 1).alias("folder"))
    lines.write.partitionBy("folder").option("maxRecordsPerFile", 500).text(path)
    # the folder comes back as part of each file's relative path
    read = corpus.read_corpus(spark, path, "main", glob="*.txt")
    rows = units.to_lines(read).withColumn("folder", F.regexp_extract("file_path", "^folder=([^/]+)/", 1))
    return rows.groupBy("folder", "indent").agg(
        F.count_if(~F.col("blank")).alias("lines"), F.sum(F.length("text")).alias("chars")
    ).select("folder", *_long("indent", "lines", "chars"))


@query
def src_decode(spark, d):
    raw = V.docs(spark, d).withColumn("content", F.encode("content", "UTF-8"))
    broken = raw.withColumn("content", F.when(
        F.pmod(F.length("content"), F.lit(3)) == 0, F.concat(F.unhex(F.lit("FF")), "content")
    ).otherwise(F.col("content")))
    kept = [
        corpus.decode_files(broken, mode).select(
            "project_name", F.lit(mode).alias("mode"), F.length("content").alias("n")
        ) for mode in ("ignore", "skip")
    ]
    return kept[0].unionByName(kept[1]).groupBy("project_name", "mode").agg(
        F.count(F.lit(1)).alias("files"), F.sum("n").alias("chars")
    )


def _versions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two deliveries of the corpus; the second repairs every file with a weak hash."""
    first = V.files(spark, d).withColumn("analyzed_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    second = V.files(spark, d).filter(F.contains("content", F.lit("md5"))).select(
        "project_name", "file_path", F.replace("content", F.lit("md5"), F.lit("sha256")).alias("content"),
        F.lit("2024-01-02 00:00:00").cast("timestamp").alias("analyzed_at"),
    )
    return documents.with_doc_id(first), documents.with_doc_id(second)


def _document_rows(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "file_path", F.md5("content").alias("content_md5"),
                     F.date_format("analyzed_at", "yyyy-MM-dd").alias("analyzed"))


@query
def sink_upsert(spark, d):
    existing, incoming = _versions(spark, d)
    return _document_rows(documents.upsert_documents(existing, incoming))


@query
def sink_quarantine(spark, d):
    parsed = verdicts.parse_verdict(V.verdict_raw(spark, d))
    return verdicts.error_summary(parsed, "event_id")


@query
def quarantine_split(spark, d):
    parsed = verdicts.parse_verdict(V.verdict_raw(spark, d))
    good, bad = verdicts.split_quarantine(parsed, F.col("error").isNull())
    return good.withColumn("side", F.lit("good")).unionByName(bad.withColumn("side", F.lit("bad"))).select("side", "event_id", "error")


@query
def documents_round_trip(spark, d):
    # everything is written, then one project again with other contents
    path = new_path(spark, "documents")
    rows = documents.with_doc_id(V.docs(spark, d))
    documents.write_documents(rows, path)
    changed = rows.filter("project_name = 'src1'").withColumn("content", F.concat("content", F.lit("!")))
    documents.write_documents(changed, path)
    return documents.read_documents(spark, path).select("project_name", "doc_id", F.md5("content").alias("content_md5"))


@query
def sink_clear_project(spark, d):
    remaining, deleted = documents.clear_project(V.docs(spark, d), "src0")
    left = remaining.groupBy("project_name").agg(F.count(F.lit(1)).alias("files"))
    return left.unionByName(deleted.select(F.lit("(deleted)").alias("project_name"), F.col("deleted").alias("files")))


@query
def src_issues(spark, d):
    rows = publish.existing_issues(V.issues(spark, d), "open", ["security", "tool"])
    return rows.select("number", "title", "url", "state", F.array_join("labels", ",").alias("labels_csv"))


@query
def src_session_latest(spark, d):
    e = V.table(spark, d, "events")
    scans = e.select(
        F.concat(F.lit("owner_repo"), "user_id").alias("session_id"), F.col("ts").alias("scanned_at"),
        F.col("event_id").alias("scan_id"), F.col("event_type").alias("status"),
    )
    return sessions.latest_scan(scans).select("session_id", "scan_id", "status")


@query
def session_drop(spark, d):
    e = V.table(spark, d, "events")
    scans = e.select(F.concat(F.lit("owner_repo"), "user_id").alias("session_id"), F.col("event_id").alias("scan_id"))
    return sessions.drop_session(scans, "owner_repo3").groupBy("session_id").agg(F.count(F.lit(1)).alias("scans"))


def _for_lookup(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` written in the layout for lookups, and read back."""
    path = new_path(df.sparkSession, "lookup")
    documents.write_for_lookup(df, path, keys)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query
def src_finding_lookup(spark, d):
    rows = _for_lookup(V.findings(spark, d), ["project_name", "seq"])
    one = sessions.findings_for(rows, "proj3", 17).withColumn("lookup", F.lit("one"))
    none = sessions.findings_for(rows, "nowhere").withColumn("lookup", F.lit("none"))
    every = sessions.findings_for(rows, "proj3").withColumn("lookup", F.lit("all"))
    return one.unionByName(none).unionByName(every).select("lookup", *_long("seq"), *F_COLS)


@query
def src_doc_lookup(spark, d):
    files = _for_lookup(V.files(spark, d), ["project_name", "file_path"])
    return documents.get_document(files, "main", "pkg7/sub3/mod_17.py").select("file_path", "content")


def _feed(spark, d) -> str:
    """The progress records as a folder of JSON lines, with blank and broken ones."""
    path = new_path(spark, "feed")
    _write_feed(V.progress_rows(spark, d), path)
    return path


def _write_feed(rows: DataFrame, path: str) -> None:
    record = F.to_json(F.struct(*rows.columns))
    junk = F.array_compact(F.array(record, F.when(F.col("seq") % 50 == 0, '{"session": 1, "phase'),
                                   F.when(F.col("seq") % 60 == 0, "")))
    rows.select(F.explode(junk).alias("value")).write.mode("append").text(path)


PROGRESS = ["session", "seq", "phase", "message", "type", "success", "pr_url", "error"]


@query
def src_stream_ndjson(spark, d):
    stream = progress.read_progress_stream(spark, _feed(spark, d))
    return progress.run_to_table(stream, "records").groupBy("session").agg(
        F.count(F.lit(1)).alias("records"), F.max("seq").alias("last_seq")
    )


# ---------------------------------------------------------------- paths and urls


@query
def path_normalize(spark, d):
    windows = V.files(spark, d).select(F.translate("file_path", "/", "\\").alias("raw"))
    return windows.select("raw", text.norm_path(F.col("raw")).alias("path"))


@query
def path_basename_stem(spark, d):
    p = F.col("file_path")
    return V.files(spark, d).select("file_path", text.basename(p).alias("basename"), text.stem(p).alias("stem"))


@query
def repo_slug(spark, d):
    return V.urls(spark, d).select("page_id", "shape", text.repo_slug(F.col("url")).alias("slug"))


@query
def repo_slug_lenient(spark, d):
    u = F.col("url")
    return V.urls(spark, d).select("page_id", "shape", *[
        text.repo_slug(u, m).alias(m) for m in ("rstrip", "ui", "change")
    ])


@query
def session_key(spark, d):
    slug = text.repo_slug(F.col("url"))
    return V.urls(spark, d).select("page_id", "shape", text.session_key(slug).alias("session_id"))


@query
def finding_project(spark, d):
    api = scoring.to_api_finding(V.findings(spark, d))
    return api.select("project_name", *_long("seq", "line", "riskScore"), "file", "title", "severity",
                      "description", "function")


@query
def truncate_fields(spark, d):
    return V.docs(spark, d).select("project_name", "file_path", *[
        text.truncated(F.col("content"), n).alias(f"first_{n}") for n in (150, 200, 300, 500, 1000)
    ])


# ---------------------------------------------------------------- filters


@query
def filter_path_segments(spark, d):
    return filters.exclude_segments(V.files(spark, d)).select("file_path")


GLOBS = ["**/sub3/**", "build/**"]


@query
def filter_path_glob(spark, d):
    files = V.files(spark, d).select("file_path")
    strict = filters.exclude_globs(files, GLOBS, "pathlib").withColumn("mode", F.lit("pathlib"))
    deep = filters.exclude_globs(files, GLOBS, "recursive", root="").withColumn("mode", F.lit("recursive"))
    return strict.unionByName(deep)


@query
def filter_path_substring(spark, d):
    return filters.exclude_substrings(V.files(spark, d), ["build", "sub5", "__pycache__"]).select("file_path")


@query
def filter_vulnerable(spark, d):
    return filters.vulnerable_only(V.finding_rows(spark, d)).select(*F_COLS)


@query
def filter_min_risk(spark, d):
    return filters.min_risk(V.finding_rows(spark, d), 5).select(*F_COLS)


def _scored(spark, d) -> DataFrame:
    return scoring.score(V.finding_rows(spark, d))


@query
def filter_actionable(spark, d):
    return filters.actionable(_scored(spark, d), 7, verified_only=True).select(*F_COLS, "final_score")


@query
def filter_strategy(spark, d):
    s = F.col("risk_score")
    names = ["all", "smart", "critical", "none", "demo", "unheard_of"]
    return V.finding_rows(spark, d).groupBy("project_name").agg(
        *[F.count_if(sev.should_verify(s, n)).alias(n) for n in names]
    )


@query
def filter_alert(spark, d):
    rows = filters.alert_level(V.finding_rows(spark, d))
    return rows.groupBy("project_name", "alert").agg(F.count(F.lit(1)).alias("findings"))


@query
def gate_critical(spark, d):
    # one gate per file: some pass, some block
    return filters.release_gate(V.finding_rows(spark, d), by="file")


@query
def filter_min_length(spark, d):
    return V.verdict_raw(spark, d).select("event_id", text.valid_payload(F.col("reply"), 15).alias("valid"))


@query
def filter_required_keys(spark, d):
    fields = F.from_json(text.strip_fences(F.col("reply")), "map<string,string>")
    rows = V.verdict_raw(spark, d).withColumn("fields", F.coalesce(fields, F.create_map().cast("map<string,string>")))
    return filters.require_keys(rows, "fields", verdicts.FIELDS).select("event_id", "error")


# ---------------------------------------------------------------- code units


@query
def lines_explode(spark, d):
    rows = units.to_lines(V.files(spark, d))
    return rows.select("file_path", *_long("line", "indent"), "text", "blank")


@query
def units_functions(spark, d):
    rows = units.extract_functions(V.files(spark, d))
    return rows.select("file_path", "name", "code", *_long("start_line", "end_line"))


@query
def units_docstring(spark, d):
    return units.extract_functions(V.files(spark, d)).select("file_path", "name", "docstring")


@query
def units_classes(spark, d):
    rows = units.extract_classes(V.files(spark, d))
    return rows.select("file_path", "name", "code", *_long("start_line", "end_line"))


@query
def units_imports_top(spark, d):
    rows = units.extract_imports(V.files(spark, d), top_level=True)
    return rows.select("file_path", *_long("line"), "code", "type")


@query
def units_imports_all(spark, d):
    # the corpus with one more import inside every function
    nested = V.files(spark, d).withColumn(
        "content", F.replace("content", F.lit("    return x\n"), F.lit("    import json\n    return x\n"))
    )
    return units.extract_imports(nested).select("file_path", *_long("line"), "code", "type")


@query
def symbols_array(spark, d):
    rows = units.symbols(V.files(spark, d))
    return rows.select("file_path", F.array_join("functions", ",").alias("symbols"))


def _rule_findings(spark, d) -> DataFrame:
    """Rule hits of the corpus's functions as findings, stored once: the hits are
    few, and queries that read them several times must not parse the corpus again."""

    def build() -> DataFrame:
        functions = units.extract_units(V.files(spark, d)).filter(F.col("node_type") == "function")
        hits = rules.scan_rules(functions, "code")
        return hits.select("project_name", F.col("file_path").alias("file"), F.col("name").alias("function"),
                           "start_line", "end_line", "rule", "type", "risk_score", "vulnerable", "description")

    return V.stored(spark, d, "rule_findings", build)


@query
def unit_lookup(spark, d):
    found = _rule_findings(spark, d)
    # names that no file defines fall back to the whole file
    lost = found.withColumn("function", F.concat("function", F.lit("_gone")))
    code = units.finding_code(found.unionByName(lost), V.files(spark, d))
    return code.select("file", "function", "rule", F.md5("code").alias("code_md5"), F.length("code").cast("bigint").alias("n"))


@query
def corpus_unit_stats(spark, d):
    return units.unit_stats(V.files(spark, d), _rule_findings(spark, d))


# ---------------------------------------------------------------- import graph


def _candidates(spark, d) -> DataFrame:
    return imports.import_candidates(units.extract_imports(V.files(spark, d)))


def corpus_edges(spark, d) -> DataFrame:
    """Edges of the corpus, stored once: graph queries read them several times."""
    return V.stored(spark, d, "edges", lambda: imports.build_edges(V.files(spark, d)))


def _roots(spark, d) -> DataFrame:
    return V.files(spark, d).select("project_name", F.col("file_path").alias("root"))


@query
def import_names(spark, d):
    return _candidates(spark, d).select("file_path", "stmt_seq", "pos", "module")


@query
def import_deny(spark, d):
    return imports.deny_modules(_candidates(spark, d)).select("file_path", "stmt_seq", "pos", "module")


@query
def import_resolve_abs(spark, d):
    asked = imports.deny_modules(_candidates(spark, d))
    return imports.resolve_absolute(asked, V.files(spark, d)).select("file_path", "stmt_seq", "pos", "dst")


@query
def import_resolve_rel(spark, d):
    asked = imports.deny_modules(_candidates(spark, d))
    return imports.resolve_relative(asked, V.files(spark, d)).select("file_path", "stmt_seq", "pos", "dst")


@query
def import_edges(spark, d):
    files = V.files(spark, d)
    return imports.build_edges(files, filters.exclude_segments(files)).select("src", "dst", "stmt_seq", "pos")


@query
def dep_direct(spark, d):
    return graph.direct_deps(V.graph_edges(spark, d)).select("src", "stmt_seq", "pos", "dst")


@query
def dep_reverse(spark, d):
    return graph.dependents(V.graph_edges(spark, d)).select("dst", "src")


@query
def dep_bfs(spark, d):
    """Everything within two steps of every file, counted per level."""
    edges = V.graph_edges(spark, d)
    roots = edges.select("project_name", F.col("src").alias("root"))

    def per_level(found: DataFrame) -> DataFrame:
        return found.groupBy("root", "level").agg(
            F.count(F.lit(1)).alias("files"), F.sum(F.col("dst").cast("bigint")).alias("checksum")
        )

    return graph.dependencies(edges, roots, 2, order=False, fold=per_level)


@query
def dep_bfs_order(spark, d):
    """Visiting order of the corpus's own graph, three steps deep."""
    found = graph.dependencies(corpus_edges(spark, d), _roots(spark, d), 3)
    return found.select("root", "dst", "level", F.array_join("order", ".").alias("visit_order"))


def _bundles(spark, d) -> DataFrame:
    return graph.context_bundle(V.files(spark, d), corpus_edges(spark, d), _roots(spark, d), 1)


@query
def context_bundle(spark, d):
    return _bundles(spark, d).select("root", "bundle")


@query
def context_for_findings(spark, d):
    # only files with findings are asked for their context
    found = materialize(_rule_findings(spark, d), "findings")
    asked = found.select("project_name", F.col("file").alias("root")).distinct()
    bundles = graph.context_bundle(V.files(spark, d), corpus_edges(spark, d), asked, 1)
    rows = graph.finding_context(found, bundles, V.files(spark, d))
    return rows.select("file", "function", "rule", F.md5("context").alias("context_md5"))


@query
def bundle_unpack(spark, d):
    rows = graph.unpack_bundle(_bundles(spark, d), "bundle")
    return rows.select("root", "name", "path", "kind", F.md5("content").alias("content_md5"))


@query
def graph_stats(spark, d):
    indexed = filters.exclude_segments(V.files(spark, d))
    edges = corpus_edges(spark, d).join(
        indexed.select("project_name", F.col("file_path").alias("src")), ["project_name", "src"], "left_semi"
    )
    return graph.graph_stats(indexed, edges)


@query
def graph_isolated(spark, d):
    # only imports from one project folder count, so that some files stay alone
    edges = imports.resolve_relative(imports.deny_modules(_candidates(spark, d)), V.files(spark, d))
    alone = graph.isolated_files(V.files(spark, d), edges.withColumnRenamed("file_path", "src"))
    return alone.select("file_path")


@query
def dep_tree(spark, d):
    known = _roots(spark, d)
    roots = known.unionByName(known.select("project_name", F.concat("root", F.lit(".gone")).alias("root")))
    rows = tree.dep_tree(corpus_edges(spark, d), roots, V.files(spark, d), 2)
    return rows.select("root", F.array_join("path", ".").alias("place"), "depth", "node", "text")


@query
def dep_tree_deep(spark, d):
    """Three levels: opened at the first visit of a walk."""
    rows = tree.dep_tree(corpus_edges(spark, d), _roots(spark, d), V.files(spark, d), 3)
    return rows.select("root", F.array_join("path", ".").alias("place"), "depth", "node", "text")


# ---------------------------------------------------------------- verdicts


@query
def fence_strip(spark, d):
    r = F.col("reply")
    return V.verdict_raw(spark, d).select(
        "event_id", text.strip_fences(r).alias("plain"), text.strip_fences(r, "split").alias("cut")
    )


@query
def verdict_parse(spark, d):
    rows = verdicts.parse_verdict(V.verdict_raw(spark, d))
    return rows.select("event_id", "vulnerable", *_long("risk_score"), "type", "description", "error")


@query
def verdict_defaults(spark, d):
    rows = verdicts.parse_verdict(V.verdict_raw(spark, d)).filter(F.col("error").isNull())
    return rows.groupBy("type", "description").agg(
        F.count(F.lit(1)).alias("verdicts"), F.sum("risk_score").alias("score_sum"),
        F.count_if("vulnerable").alias("vulnerable"),
    )


def _json_values(spark, d) -> DataFrame:
    """JSON values of every kind, one per event."""
    e = V.table(spark, d, "events").select("event_id", "value")
    i = F.col("event_id") % 12
    shapes = ["8", '" 8 "', '"high"', "true", "false", "null", "[1]", '"false"', '""', "-3", '"-7"']
    raw = F.when(i == 11, F.col("value").cast("decimal(18,2)").cast("string"))
    for n, shape in enumerate(shapes):
        raw = raw.when(i == n, shape)
    return e.select("event_id", raw.alias("raw"), F.try_parse_json(raw).alias("v"))


@query
def verdict_clamp(spark, d):
    return _json_values(spark, d).select("event_id", verdicts.clamp_score(F.col("v")).cast("bigint").alias("score"))


@query
def verdict_bool(spark, d):
    v = F.col("v")
    return _json_values(spark, d).select(
        "event_id", verdicts.truthy(v).alias("truthy"), verdicts.truthy(v, compat=False).alias("read")
    )


@query
def json_field_regex(spark, d):
    # replies cut off before their closing brace are not JSON any more
    rows = V.verdict_raw(spark, d).withColumn("cut", F.regexp_replace("reply", r"\}[^}]*$", ""))
    out = verdicts.extract_json_strings(rows.drop("reply"), "cut", ["type", "description"])
    return out.select("event_id", "type", "description")


@query
def error_findings(spark, d):
    rows = verdicts.with_analysis_errors(verdicts.parse_verdict(V.verdict_raw(spark, d)))
    return rows.select("event_id", "vulnerable", *_long("risk_score"), "type", "description")


@query
def finding_assemble(spark, d):
    found = units.extract_units(V.files(spark, d)).filter(F.col("node_type") == "function")
    hits = rules.scan_rules(found, "code")
    worst = hits.groupBy("project_name", "file_path", "pos").agg(
        F.max(F.struct("risk_score", "type", "description", "vulnerable")).alias("w")
    )
    # every scanned unit has a verdict; the analysis of each thirteenth file fails
    number = F.regexp_extract("file_path", r"mod_(\d+)\.py$", 1).cast("bigint")
    key = ["project_name", "file_path", "pos"]
    scanned = found.select(*key).filter(number % 13 != 0).join(worst, key, "left").select(
        *key, F.coalesce("w.vulnerable", F.lit(False)).alias("vulnerable"), F.coalesce("w.risk_score", F.lit(0)).alias("risk_score"),
        F.coalesce("w.type", F.lit("None")).alias("type"), F.coalesce("w.description", F.lit("No issue found")).alias("description"),
    )
    rows = verdicts.assemble_findings(found, scanned)
    return rows.select("file", "function", *_long("pos", "start_line", "end_line", "risk_score"), "vulnerable",
                       "type", "description")


@query
def rule_scan(spark, d):
    hits = rules.scan_rules(V.docs(spark, d), "content")
    return hits.select("project_name", "file_path", "rule", "type", *_long("risk_score"))


@query
def rule_scan_units(spark, d):
    return _rule_findings(spark, d).select("file", "function", "rule", *_long("risk_score", "start_line"))


@query
def rule_places(spark, d):
    """Every place in the corpus where a rule's pattern occurs."""
    rows = rules.rule_places(V.files(spark, d).select("file_path", "content"), "content")
    return rows.select("file_path", "rule", *_long("nth", "line", "column"), "match")


@query
def rule_summary(spark, d):
    both = rules.scan_rules(V.docs(spark, d), "content").select("project_name", "rule", "type").unionByName(
        rules.scan_rules(V.files(spark, d), "content").select("project_name", "rule", "type")
    )
    return rules.rule_summary(both)


def _tiers(spark, d) -> DataFrame:
    """Three replies per request; the first fails on two event kinds, the others on
    some ids."""
    e = V.table(spark, d, "events").select("event_id", "event_type", "user_id")
    kind, i = F.col("event_type"), F.col("event_id")
    first_bad, second_bad, third_bad = kind.isin("error", "view"), (i + F.col("user_id")) % 4 == 0, i % 3 == 0
    rows = F.array(
        F.struct(F.lit(1).alias("tier"), (~first_bad).alias("ok"), F.concat(F.lit("one "), kind).alias("reply"),
                 F.when(first_bad, F.concat(F.lit("429 for "), kind)).alias("error")),
        F.struct(F.lit(2).alias("tier"), (~second_bad).alias("ok"), F.concat(F.lit("two "), kind).alias("reply"),
                 F.when(second_bad, F.lit("Connection reset")).alias("error")),
        F.struct(F.lit(3).alias("tier"), (~third_bad).alias("ok"), F.concat(F.lit("three "), kind).alias("reply"),
                 F.when(third_bad, F.lit("No such model")).alias("error")),
    )
    return e.select("event_id", F.explode(rows).alias("r")).select("event_id", "r.*")


@query
def tier_fallback(spark, d):
    rows = verdicts.resolve_tiers(_tiers(spark, d), "event_id", ["primary", "fallback", "last"])
    return rows.select("event_id", *_long("tier"), "reply", "switches", "error")


@query
def error_classify(spark, d):
    e = V.table(spark, d, "events").select("event_id", "event_type")
    texts = ["Rate limit reached", "HTTP 429", "Too Many Requests", "read TIMEOUT", "Connection refused",
             "Quota exceeded for key", "bad request", "connection timeout"]
    i = F.col("event_id") % 8
    message = F.when(i == 0, texts[0])
    for n, t in enumerate(texts[1:], 1):
        message = message.when(i == n, t)
    m = F.concat(F.col("event_type"), F.lit(": "), message)
    return e.select("event_id", errors.classify_error(m).alias("error_class"), errors.is_retryable(m).alias("retryable"))


@query
def chat_assemble(spark, d):
    rows = verdicts.assemble_chat(V.messages(spark, d))
    prompts = verdicts.user_prompts(V.messages(spark, d))
    return rows.join(prompts, "conv_id").select(
        "conv_id", "position", "role", F.md5("text").alias("text_md5"), F.md5("user_prompt").alias("prompt_md5")
    )


@query
def prompt_render(spark, d):
    found = units.extract_units(V.files(spark, d)).filter(F.col("node_type") == "function")
    return verdicts.render_audit_prompt(found).select("file_path", "name", "prompt")


# ---------------------------------------------------------------- scoring and reports


@query
def risk_final(spark, d):
    rows = _scored(spark, d)
    return rows.select("project_name", "file", "function", *_long("risk_score", "final_score"), "label",
                       "action_recommended", "priority")


@query
def severity_ladders(spark, d):
    s = F.col("risk_score")
    names = [*sev.LADDERS, "badge"]
    rows = V.finding_rows(spark, d).select("project_name", s, *[sev.severity(s, n).alias(n) for n in names])
    return rows.groupBy("project_name", *names).agg(
        F.count(F.lit(1)).alias("findings"), F.sum("risk_score").alias("score_sum")
    )


@query
def score_effective(spark, d):
    # verified rows carry a final score, the others only the auditor's
    final = F.when(F.col("verified"), F.col("final_score"))
    rows = _scored(spark, d).withColumn("final_score", final)
    return rows.select("project_name", "file", "function", filters.effective_score(rows).cast("bigint").alias("score"))


def _scored_seq(spark, d) -> DataFrame:
    return scoring.score(V.findings(spark, d))


@query
def rank_findings(spark, d):
    vulnerable = filters.vulnerable_only(_scored_seq(spark, d))
    return scoring.ranked(vulnerable).select("project_name", *_long("seq", "final_score", "rank"))


@query
def rank_overall(spark, d):
    rows = scoring.ranked_overall(filters.vulnerable_only(_scored_seq(spark, d)))
    return rows.select("project_name", *_long("seq", "final_score", "rank"))


@query
def number_findings(spark, d):
    rows = scoring.number_findings(filters.vulnerable_only(V.findings(spark, d)))
    return rows.select("project_name", *_long("seq", "id"), "file", "function")


@query
def verify_budget(spark, d):
    rows = scoring.validated(V.findings(spark, d), "smart", 25)
    return scoring.ranked(rows).select("project_name", *_long("seq", "final_score", "rank"), "selected", "label")


def _check_results(spark, d) -> DataFrame:
    checked = att.first_success(V.attempts(spark, d))
    return checked.withColumn("evidence", F.when(F.col("verified"), F.col("output")).otherwise(""))


@query
def verify_merge(spark, d):
    rows = scoring.merge_verification(V.finding_rows(spark, d), _check_results(spark, d))
    return rows.select("project_name", "file", "function", *_long("finding_id", "risk_score", "final_score"), "verified",
                       "exploit_output", "verification_error", "label", "severity_rating")


def _finding_files(spark, d) -> DataFrame:
    return V.finding_rows(spark, d).select("project_name", "file").distinct()


@query
def summary_api(spark, d):
    vulnerable = filters.vulnerable_only(V.finding_rows(spark, d))
    return reports.summary_by_severity(vulnerable, files=_finding_files(spark, d))


@query
def summary_audit(spark, d):
    return reports.audit_summary(filters.vulnerable_only(_scored(spark, d)))


@query
def report_audit(spark, d):
    return reports.audit_report(V.finding_rows(spark, d))


@query
def report_audit_rows(spark, d):
    return reports.audit_report_rows(V.finding_rows(spark, d)).select(*F_COLS, "band")


@query
def report_priority(spark, d):
    return reports.priority_report(_scored(spark, d))


@query
def topk_per_band(spark, d):
    rows = reports.top_per_band(_scored_seq(spark, d))
    return rows.select("project_name", "band", *_long("idx", "seq", "final_score"), "type", "function")


@query
def summary_verified(spark, d):
    return reports.verification_summary(_scored(spark, d), "project_name")


@query
def review_reduction(spark, d):
    return reports.review_reduction(_scored(spark, d))


@query
def metric_max_risk(spark, d):
    rows = filters.vulnerable_only(V.finding_rows(spark, d))
    files = _finding_files(spark, d).withColumn("project_name", F.concat("project_name", F.lit("/"), F.substring("file", 1, 4)))
    keyed = rows.withColumn("project_name", F.concat("project_name", F.lit("/"), F.substring("file", 1, 4)))
    return reports.dashboard_metrics(keyed, files)


@query
def pick_front(spark, d):
    rows = scoring.ranked(filters.vulnerable_only(V.findings(spark, d)))
    return scoring.pin_first(rows, 5).select("project_name", *_long("seq", "rank", "position"))


@query
def queue_order(spark, d):
    rows = V.findings(spark, d)
    selected = rows.filter("verified").select("project_name", "seq")
    return scoring.work_queue(rows, selected).select(
        "project_name", *_long("seq", "position", "next_item"), "state"
    )


def _done(spark, d) -> DataFrame:
    return V.findings(spark, d).filter("verified and risk_score >= 6").select("project_name", "seq")


@query
def remaining_work(spark, d):
    rows = scoring.remaining(V.findings(spark, d), _done(spark, d), ["project_name", "seq"])
    return rows.groupBy("project_name").agg(F.count(F.lit(1)).alias("remaining"), F.min("seq").alias("first_seq"))


@query
def remediated_links(spark, d):
    links = V.issues(spark, d).select(
        F.concat(F.lit("proj"), F.col("number") % 20).alias("project_name"),
        F.floor(F.col("number") / 40).cast("bigint").alias("seq"), "url", "number",
    )
    rows = scoring.remediated(V.findings(spark, d), _done(spark, d), links, ["project_name", "seq"])
    return rows.select("project_name", *_long("seq"), "type", "url")


@query
def action_log_summary(spark, d):
    e = V.table(spark, d, "events").select("event_id", "user_id", "event_type")
    kind = F.col("event_type")
    log = e.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"),
        F.when(kind.isin("purchase", "click"), "F").when(kind == "error", "E").otherwise("S").alias("action"),
        (kind == "purchase").alias("success"),
    )
    return scoring.session_actions(log)


# ---------------------------------------------------------------- attempt logs


@query
def outcome_classify(spark, d):
    rows = att.classify_outcome(V.attempt_rows(spark, d))
    return rows.select("finding_id", "event_id", "ok")


@query
def outcome_reason(spark, d):
    # the documents' text as output brings in the indicator and clean branches
    docs = V.docs(spark, d).select("file_path", F.col("content").alias("stdout"), F.lit(0).alias("exit_code"))
    logs = V.attempt_rows(spark, d).select(F.lit("log").alias("file_path"), "stdout", "exit_code")
    rows = att.classify_outcome(docs.unionByName(logs))
    return rows.groupBy("reason", "ok").agg(F.count(F.lit(1)).alias("runs"))


@query
def first_success(spark, d):
    return att.first_success(V.attempts(spark, d)).select(
        "finding_id", "verified", "attempts", "output", "error"
    )


@query
def attempt_failures(spark, d):
    # a signup event stands for an attempt whose text could not be generated
    log = V.attempts(spark, d)
    never = (F.col("stdout") == "") & (F.col("exit_code") == 0)
    return att.failure_records(log.withColumn("generation_error", F.when(never, F.lit("no reply"))))


@query
def attempt_history_digest(spark, d):
    return att.history_digest(V.attempts(spark, d))


def _fix_log(spark, d) -> DataFrame:
    """The log with the first run as the baseline, attempt 0; the protocol's attempts only,
    so that the numbering keeps as few of a finding below its shuffle."""
    return V.attempts(spark, d).filter(F.col("attempt") <= att.MAX_ATTEMPTS + 1).withColumn("attempt", F.col("attempt") - 1)


@query
def baseline_gate(spark, d):
    return att.baseline_gate(_fix_log(spark, d))


@query
def fix_verified(spark, d):
    return att.first_fixed(_fix_log(spark, d))


@query
def attempt_rates(spark, d):
    results = att.first_fixed(_fix_log(spark, d)).withColumn("day", F.col("finding_id") % 100)
    return att.attempt_rates(results, "day")


@query
def verification_status(spark, d):
    checks = att.verification_status(_check_results(spark, d)).withColumn("kind", F.lit("check"))
    fixes = att.verification_status(att.first_fixed(_fix_log(spark, d)), "fix").withColumn("kind", F.lit("fix"))
    return checks.unionByName(fixes)


# ---------------------------------------------------------------- publishing


@query
def issue_title(spark, d):
    rows = V.finding_rows(spark, d)
    return rows.select("project_name", publish.issue_title().alias("title"), publish.issue_title("file").alias("file_title"))


@query
def issue_dedupe(spark, d):
    # issues about two of the four types, so that both outcomes occur
    known = publish.existing_issues(V.issues(spark, d), "open", ["security", "tool"])
    known = known.withColumn("title", F.regexp_replace("title", "(Weak Hashing|Path Traversal)", "Other"))
    rows = publish.new_issues(filters.min_risk(V.finding_rows(spark, d), 5), known)
    return rows.select("project_name", "file", "function", *_long("risk_score"), "title")


@query
def issue_dedupe_batch(spark, d):
    known = publish.existing_issues(V.issues(spark, d), "open", ["security", "tool"])
    known = known.withColumn("title", F.regexp_replace("title", "(Weak Hashing|Path Traversal)", "Other"))
    rows = publish.new_issues(filters.min_risk(V.finding_rows(spark, d), 5), known, within_batch=True)
    return rows.select("title", *_long("risk_score"))


@query
def issue_labels(spark, d):
    rows = _scored(spark, d)
    return rows.select(
        "project_name", "file", "function", *_long("risk_score"),
        F.array_join(publish.issue_labels("audit"), ",").alias("audit_labels"),
        F.array_join(publish.issue_labels("verified"), ",").alias("verified_labels"),
    )


@query
def issue_body(spark, d):
    rows = _scored(spark, d).withColumn("exploit_output", F.concat(F.lit("ran "), "function"))
    audit = publish.issue_body(rows, "audit").withColumn("template", F.lit("audit"))
    full = publish.issue_body(rows, "verified").withColumn("template", F.lit("verified"))
    return audit.unionByName(full).select("template", "file", "function", "body")


@query
def change_record(spark, d):
    fixes = V.findings(spark, d).select(
        F.col("project_name").alias("repo"), F.col("seq").alias("number"), "type", "file",
        F.when(F.col("verified"), F.col("evidence")).otherwise("").alias("content"),
    )
    existing = V.issues(spark, d).select(
        F.concat(F.lit("proj"), F.col("number") % 20).alias("repo"),
        F.concat(F.lit("security/fix-"), F.floor(F.col("number") / 40).cast("bigint")).alias("branch"), "state", "url",
    )
    rows = publish.change_records(fixes, existing)
    return rows.select("repo", "branch", *_long("number"), "title", "commit_message", "body", "existing_url")


# ---------------------------------------------------------------- streams


@query
def stream_parse(spark, d):
    return progress.run_to_table(progress.read_progress_stream(spark, _feed(spark, d)), "parsed").select(*PROGRESS)


@query
def stream_route(spark, d):
    stream = progress.route(progress.read_progress_stream(spark, _feed(spark, d)))
    return progress.run_to_table(stream, "routed").select("session", "seq", "lane", "message")


@query
def stream_type_map(spark, d):
    stream = progress.read_progress_stream(spark, _feed(spark, d))
    shown = progress.route(stream).withColumn("shown", progress.map_type(F.col("type")))
    return progress.run_to_table(shown, "typed").select("session", "seq", "type", "shown")


@query
def stream_terminal(spark, d):
    ends = progress.terminal(progress.read_progress_stream(spark, _feed(spark, d)))
    rows = progress.run_to_table(ends, "ends")
    return rows.select("session", "seq", "success", F.col("pr_url").isNotNull().alias("strict"), "pr_url", "error")


@query
def stream_session_state(spark, d):
    # the feed arrives in five deliveries, in the order of its records
    feed, state, checkpoint = (new_path(spark, n) for n in ("feed", "state", "state-checkpoint"))
    rows = V.progress_rows(spark, d)
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    part = F.least(F.floor((F.col("seq") - low) * 5 / (high - low + 1)), F.lit(4))
    for i in range(5):
        _write_feed(rows.filter(part == i), feed)
        stream = progress.read_progress_stream(spark, feed)
        progress.start_session_state(stream, state, checkpoint, snapshot_every=3).awaitTermination()
    return progress.read_state(spark, state)


@query
def stream_upsert(spark, d):
    source, table, checkpoint = (new_path(spark, n) for n in ("deliveries", "index", "index-checkpoint"))
    for delivery in _versions(spark, d):
        delivery.write.mode("append").parquet(source)
        stream = spark.readStream.schema(index_stream.SCHEMA).parquet(source)
        index_stream.start_index_stream(stream, table, checkpoint).awaitTermination()
    return _document_rows(index_stream.read_index(spark, table))


def _graph_deliveries(spark, d) -> str:
    """The corpus in three deliveries: two thirds of the files, every fifth of them in an
    old version without imports; the rest; and versions that came too late."""
    files, n = V.files(spark, d), F.regexp_extract("file_path", r"mod_(\d+)\.py$", 1).cast("bigint")
    at = lambda df, day: df.withColumn("analyzed_at", F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp"))
    old = F.when(n % 5 == 0, F.lit("import nothing\ndef old(): pass\n")).otherwise(F.col("content"))
    deliveries = [
        at(files.filter(n % 3 != 0).withColumn("content", old), 2), at(files.filter((n % 3 == 0) | (n % 5 == 0)), 3),
        at(files.filter(n % 7 == 0).withColumn("content", F.lit("def late(): pass\n")), 1),
    ]
    source, folder, checkpoint = (new_path(spark, x) for x in ("versions", "graph-index", "graph-checkpoint"))
    for delivery in deliveries:
        delivery.select("project_name", "file_path", "content", "analyzed_at").write.mode("append").parquet(source)
        stream = spark.readStream.schema("project_name string, file_path string, content string, analyzed_at timestamp").parquet(source)
        graph_index.start_graph_stream(stream, folder, checkpoint).awaitTermination()
    return folder


@query
def stream_graph(spark, d):
    """Edges kept up to date over deliveries equal those of the whole corpus."""
    edges = graph_index.read_edges(spark, _graph_deliveries(spark, d))
    return edges.select("src", "dst", "stmt_seq", "pos")


@query
def stream_documents(spark, d):
    """Documents with symbols and imports after the same deliveries."""
    rows = graph_index.read_indexed(spark, _graph_deliveries(spark, d))
    return rows.select("file_path", F.md5("content").alias("content_md5"), F.array_join("functions", ",").alias("symbols"), F.array_join("imports", ",").alias("imports"))


# ---------------------------------------------------------------- whole scan


@query
def scan_repository(spark, d):
    """Files to ranked findings: filter, extract, scan, band, number, rank."""
    files = filters.exclude_segments(V.files(spark, d))
    functions = units.extract_units(files).filter(F.col("node_type") == "function")
    hits = rules.scan_rules(functions, "code")
    found = hits.select(
        "project_name", F.col("file_path").alias("file"), F.col("name").alias("function"), "start_line", "type",
        "risk_score", "vulnerable", sev.severity(F.col("risk_score"), "api").alias("severity"),
        F.regexp_extract("file_path", r"mod_(\d+)\.py$", 1).cast("bigint").alias("file_no"), "pos",
        F.array_position(F.array(*[F.lit(r.name) for r in rules.RULES]), F.col("rule")).alias("rule_no"),
    )
    # scan order: file, unit in the file, rule on the unit; the corpus is parsed once
    numbered = group_position(found, ["project_name"], ["file_no", "pos", "rule_no"], "id")
    ranked = scoring.ranked(numbered, seq="id")
    return ranked.select("project_name", "id", "rank", "file", "function", "type", "severity",
                         *_long("risk_score", "start_line"))
