"""Query catalog: one entry per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeatlas.functions import text, urls
from forgeatlas.operators import content_language, content_metrics, enrich, files, hosts, languages, metrics, rdf, registry, rule_index, runners
from forgeatlas.operators.order import fill_by_row_id, number_rows
from forgeatlas.plans import analysis, enrichment, flow, inputs, oracles
from forgeatlas.plans.api_enrichment import run_api_enrichment
from forgeatlas.plans.cleaning import clean_rows, repositories_per_host
from forgeatlas.plans.inputs import derive
from forgeatlas.schemas import CODE_METRICS, GUESSED_LANGUAGES, REGISTRY_CLEAN, REGISTRY_COLUMNS
from forgeatlas.session import cut_lineage, parallelism, scratch_path
from forgeatlas.sources import api_json, bucket_table, host_layout, ntriples, reports, tables, tree, tree_source, tsv, turtle
from forgeatlas.streaming.progress import measure_stream, measured

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


# Shared steps ---------------------------------------------------------------


def _clean(spark, sf_dir):
    return clean_rows(inputs.registry(spark, sf_dir))


def _trimmed(spark, sf_dir):
    filled = fill_by_row_id(inputs.registry(spark, sf_dir), REGISTRY_COLUMNS[:2])
    return filled.withColumn("repourl", urls.trim_url(F.col("repourl")))


def _enriched(spark, sf_dir):
    return _clean(spark, sf_dir).selectExpr("*", *_split_select(inputs.ENRICHMENT))


def _split_select(select_list: str) -> list[str]:
    """Top-level items of a select list."""
    items, depth, item = [], 0, ""
    for char in select_list:
        depth += (char == "(") - (char == ")")
        if char == "," and depth == 0:
            items.append(item)
            item = ""
        else:
            item += char
    return [i.strip() for i in [*items, item]]


def _spread(df, key):
    """Few input splits (small tables) are spread over the cores before Python work."""
    tasks = parallelism(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks, key)


def _file_paths(spark, sf_dir):
    files_ = inputs.files(spark, sf_dir)
    return files_.withColumn("rel_path", F.concat_ws("/", "dir", "name"))


# Registry -------------------------------------------------------------------


@query
def registry_clean(spark, sf_dir):
    return _clean(spark, sf_dir)


@query
def registry_ffill(spark, sf_dir):
    filled = fill_by_row_id(inputs.registry(spark, sf_dir), REGISTRY_COLUMNS[:2])
    return filled.select("row_id", *REGISTRY_COLUMNS)


@query
def registry_dup_flag(spark, sf_dir):
    return registry.mark_duplicates(_trimmed(spark, sf_dir)).select("row_id", "duplicate_flag")


@query
def registry_null_flag(spark, sf_dir):
    flagged = registry.mark_duplicates(_trimmed(spark, sf_dir))
    return registry.mark_null_values(flagged).select("row_id", "null_value_flag")


@query
def url_trim_https(spark, sf_dir):
    trimmed = inputs.registry(spark, sf_dir).withColumn("repourl", urls.trim_url(F.col("repourl")))
    return registry.convert_http_to_https(trimmed).select("row_id", "repourl")


@query
def url_canonical(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    url = urls.canonical_scheme(urls.strip_trailing_slash(F.col("url")))
    return pages.select("page_id", url.alias("url"))


@query
def url_owner_repo(spark, sf_dir):
    rows = url_trim_https(spark, sf_dir)
    return rows.select("row_id", urls.owner_and_repo(F.col("repourl")).alias("owner_repo"))


@query
def url_repo_name(spark, sf_dir):
    keyed = enrich.with_repo_key(_clean(spark, sf_dir))
    return keyed.select("row_id", urls.repo_name(F.col("repourl")).alias("repo_name"), "repo_key")


@query
def sanitise(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return text.with_sanitised(pages, "url", "safe_name").select("page_id", "safe_name")


@query
def url_domain(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", urls.host(F.col("url")).alias("domain"))


@query
def url_flags(spark, sf_dir):
    return _clean(spark, sf_dir).select(
        "row_id", "repodomain", "unsupported_url_scheme", "incomplete_url_flag"
    )


@query
def base_repo_url(spark, sf_dir):
    return _clean(spark, sf_dir).select("row_id", "base_repo_url", "base_repo_url_flag")


@query
def quality_profile(spark, sf_dir):
    return registry.quality_profile(_clean(spark, sf_dir))


@query
def table_profile(spark, sf_dir):
    return registry.table_profile(inputs.registry(spark, sf_dir))


# Hosts ----------------------------------------------------------------------


@query
def host_counts(spark, sf_dir):
    return hosts.host_counts(_clean(spark, sf_dir))


@query
def host_split(spark, sf_dir):
    return hosts.host_split(_clean(spark, sf_dir))


@query
def small_host_total(spark, sf_dir):
    return hosts.small_host_total(_clean(spark, sf_dir))


@query
def small_host_rows(spark, sf_dir):
    return hosts.small_host_rows(_clean(spark, sf_dir)).select("row_id", "repodomain")


@query
def distinct_hosts(spark, sf_dir):
    return hosts.distinct_hosts(_clean(spark, sf_dir))


@query
def top_hosts(spark, sf_dir):
    return hosts.top_hosts(_clean(spark, sf_dir))


@query
def host_report(spark, sf_dir):
    lines = hosts.report_lines(_clean(spark, sf_dir))
    order = [F.desc_nulls_first("n"), F.asc("first_row_id")]
    return number_rows(lines, order, "line_no").select("line_no", "line")


@query
def host_buckets(spark, sf_dir):
    return hosts.with_bucket(_clean(spark, sf_dir)).select("row_id", "bucket")


@query
def per_host_tables(spark, sf_dir):
    folder = scratch_path(spark, "by_host")
    reports.write_per_host(_clean(spark, sf_dir), folder)
    return spark.read.parquet(folder).groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("row_id").alias("row_ids")
    )


@query
def host_slice(spark, sf_dir):
    """The largest and the smallest host, read back from the layout of all hosts."""
    folder = scratch_path(spark, "hosts")
    host_layout.write_hosts(_clean(spark, sf_dir), folder, rows_per_file=50)
    sizes = host_layout.host_files(spark, folder).groupBy("repodomain").agg(F.sum("n").alias("n"))
    ends = [sizes.orderBy(order, "repodomain").first() for order in (F.desc("n"), F.asc("n"))]
    found = [host_layout.read_host(spark, folder, end["repodomain"]) for end in ends]
    return found[0].unionByName(found[1]).select("row_id", "repodomain", "repourl")


@query
def null_host_rows(spark, sf_dir):
    return hosts.null_host_rows(_clean(spark, sf_dir)).select("row_id", "repourl")


# Files and runners ----------------------------------------------------------


@query
def path_parts(spark, sf_dir):
    paths = _file_paths(spark, sf_dir).select("doc_id", "rel_path")
    return files.with_path_parts(paths)


@query
def test_file_count(spark, sf_dir):
    return files.count_test_files(inputs.files(spark, sf_dir))


@query
def test_file_count_search(spark, sf_dir):
    return files.count_test_files(inputs.files(spark, sf_dir), files.SEARCH_EXCLUDED)


@query
def test_file_list(spark, sf_dir):
    return files.list_test_files(inputs.files(spark, sf_dir)).select("host", "repo", "dir", "name")


@query
def tree_profile(spark, sf_dir):
    return files.tree_profile(inputs.files(spark, sf_dir))


@query
def runner_config_hits(spark, sf_dir):
    return runners.rule_matches(inputs.files(spark, sf_dir), "config_files")


@query
def runner_pattern_hits(spark, sf_dir):
    return runners.rule_matches(inputs.files(spark, sf_dir), "file_patterns")


@query
def runner_dependency_hits(spark, sf_dir):
    return runners.rule_matches(inputs.files(spark, sf_dir), "dependency_patterns")


@query
def runner_rules_many(spark, sf_dir):
    """A rule from every document against the names of all files."""
    files_ = derive(spark, sf_dir, inputs.NAMED_FILES)
    of_runner: dict[str, list[str]] = {}
    for row in derive(spark, sf_dir, inputs.NAME_RULES).toLocalIterator():
        of_runner.setdefault(row["runner"], []).append(row["pattern"])
    rules = [runners.RunnerRules(name, file_patterns=tuple(found)) for name, found in of_runner.items()]
    return rule_index.match_rules(files_, "file_patterns", rules, compiled=0)


@query
def runner_evidence(spark, sf_dir):
    return runners.detect_test_runners(inputs.files(spark, sf_dir))


# Enrichment -----------------------------------------------------------------


@query
def processable(spark, sf_dir):
    return enrich.processable(_clean(spark, sf_dir)).select("row_id", "repourl")


@query
def resume_pending(spark, sf_dir):
    keyed = enrich.with_repo_key(_enriched(spark, sf_dir))
    waiting = enrich.pending(
        keyed.filter(F.col("repo_key").isNotNull()).select("row_id", "repo_key"),
        keyed.filter(F.col("repo_key").isNotNull()),
    )
    return waiting.select("row_id", "repo_key")


@query
def progress(spark, sf_dir):
    return enrich.progress(_enriched(spark, sf_dir))


@query
def key_collisions(spark, sf_dir):
    return enrich.key_collisions(enrich.with_repo_key(_clean(spark, sf_dir)))


@query
def match_tree(spark, sf_dir):
    keyed = enrich.with_repo_key(_clean(spark, sf_dir)).select("row_id", "repo_key")
    return enrich.match_tree(keyed, derive(spark, sf_dir, inputs.TREE_REPOS)).select(
        "row_id", "repo_key"
    )


@query
def writeback(spark, sf_dir):
    keyed = enrich.with_repo_key(enrich.init_result_columns(_clean(spark, sf_dir)))
    results = derive(spark, sf_dir, inputs.TREE_REPOS).withColumn(
        "clone_status", F.lit("successful")
    )
    return enrich.write_back(keyed, results).select(
        "row_id", "repo_key", "testfilecountlocal", "clone_status"
    )


@query
def enrich_failures(spark, sf_dir):
    full = enrichment.enrich_registry(
        _clean(spark, sf_dir), derive(spark, sf_dir, inputs.TREE_REPOS),
        failures=derive(spark, sf_dir, inputs.FAILED_REPOS),
    )
    return full.select("row_id", "repo_key", "testfilecountlocal", "clone_status")


@query
def failure_log(spark, sf_dir):
    log = enrichment.failure_log(
        _clean(spark, sf_dir), derive(spark, sf_dir, inputs.FAILED_REPOS)
    )
    return log.select("row_id", "repo_key", "error_message")


@query
def explanations(spark, sf_dir):
    return enrich.add_explanations(_enriched(spark, sf_dir)).select("row_id", "explanation")


# Flow graph -----------------------------------------------------------------


@query
def test_bucket(spark, sf_dir):
    return flow.with_flow_columns(_enriched(spark, sf_dir)).select("row_id", "test_file_category")


@query
def primary_runner(spark, sf_dir):
    return flow.with_flow_columns(_enriched(spark, sf_dir)).select(
        "row_id",
        "primary_runner",
        "JUnit_total",
        "pytest_total",
        "Mocha_total",
        "No_test_runner_detected",
    )


@query
def cloned_rows(spark, sf_dir):
    return _enriched(spark, sf_dir).filter(F.col("clone_status") == "successful").select("row_id")


@query
def flow_nodes(spark, sf_dir):
    return flow.flow_nodes(flow.flow_counts(_enriched(spark, sf_dir)))


@query
def flow_links(spark, sf_dir):
    return flow.flow_graph(_enriched(spark, sf_dir))[1]


# RDF ------------------------------------------------------------------------


def _explained(spark, sf_dir):
    return enrich.add_explanations(_enriched(spark, sf_dir))


@query
def row_triples(spark, sf_dir):
    return rdf.row_triples(_explained(spark, sf_dir), inputs.PROJECT_BASE)


@query
def triple_count(spark, sf_dir):
    return rdf.statement_count(rdf.row_triples(_explained(spark, sf_dir), inputs.PROJECT_BASE))


def _observations(spark, sf_dir):
    observed = derive(spark, sf_dir, inputs.OBSERVATIONS)
    return rdf.observation_triples(observed, "https://github.com/example/project/")


@query
def observation_triples(spark, sf_dir):
    return _observations(spark, sf_dir)


@query
def observation_graph(spark, sf_dir):
    return rdf.as_graph(_observations(spark, sf_dir))


@query
def ntriples_scan(spark, sf_dir):
    """Documents of all rows written as text, scanned again as a set of statements."""
    folder = scratch_path(spark, "rdf")
    reports.write_documents(_explained(spark, sf_dir), folder, inputs.PROJECT_BASE)
    return rdf.as_graph(ntriples.read_ntriples(spark, folder))


@query
def turtle_scan(spark, sf_dir):
    """Documents of all rows written over many lines, read in chunks that cut statements."""
    folder = scratch_path(spark, "rdf")
    reports.write_documents(_explained(spark, sf_dir), folder, inputs.PROJECT_BASE, turtle=True)
    return rdf.as_graph(turtle.read_turtle(spark, folder, chunk_chars=5_000))


@query
def rejected_documents(spark, sf_dir):
    """Rows that the RDF sink cannot write, as it stores them."""
    folder = scratch_path(spark, "rdf")
    rejected = f"{folder}-rejected"
    reports.write_documents(_explained(spark, sf_dir), folder, inputs.PROJECT_BASE, rejected=rejected)
    return spark.read.parquet(rejected)


# Languages ------------------------------------------------------------------


@query
def language_label(spark, sf_dir):
    labelled = languages.label_files(inputs.files(spark, sf_dir))
    return labelled.select("doc_id", "guessed_language")


@query
def language_patterns(spark, sf_dir):
    """Files without a suffix, told by how they begin."""
    labelled = languages.label_files(derive(spark, sf_dir, inputs.HEADED))
    return labelled.select("doc_id", "guessed_language")


@query
def language_content(spark, sf_dir):
    """Languages learned from the contents of labelled files, for all files."""
    rows = derive(spark, sf_dir, inputs.UNTOLD)
    files_ = _spread(rows, "doc_id")
    model = content_language.fit(files_.filter("language IS NOT NULL"))
    labelled = content_language.label_by_content(files_.drop("language"), model, key="doc_id")
    return labelled.select("doc_id", "language", "score")


def _load_marker_model():
    """Stand-in for a trained classifier: looks for two markers in the whole text."""

    def predict(texts):
        return [
            "XML" if "junit:junit" in t else "JSON" if "devDependencies" in t else languages.UNKNOWN
            for t in texts
        ]

    return predict


@query
def language_model_hook(spark, sf_dir):
    labelled = languages.label_files(inputs.files(spark, sf_dir), _load_marker_model)
    return labelled.select("doc_id", "guessed_language")


@query
def language_pending(spark, sf_dir):
    done = derive(spark, sf_dir, inputs.LABELLED_PATHS)
    return languages.unlabelled(
        inputs.sources(spark, sf_dir).select("doc_id", "file_path"), done
    ).select("doc_id", "file_path")


@query
def language_upsert(spark, sf_dir):
    """A stored table of labels, updated in two rounds; the second one changes nothing."""
    labelled = languages.label_files(inputs.files(spark, sf_dir)).withColumn(
        "file_path", F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".py"))
    )
    done = derive(spark, sf_dir, inputs.LABELLED_PATHS)
    stored = languages.language_rows(
        labelled.join(done, "file_path", "left_semi").withColumn("guessed_language", F.lit("old")),
        now=F.expr("timestamp '2024-01-01 00:00:00'"),
        hostname="node-1",
    )
    update = languages.language_rows(
        labelled, now=F.expr("timestamp '2024-03-01 00:00:00'"), hostname="node-2"
    )
    table = bucket_table.BucketTable(spark, scratch_path(spark, "labels"), GUESSED_LANGUAGES).create(16)
    table.upsert(stored, now=F.expr("timestamp '2024-01-01 00:00:00'"))
    for day in ("2024-06-01", "2024-07-01"):
        table.upsert(update, now=F.lit(f"{day} 00:00:00").cast("timestamp"))
    return table.read().select(
        "file_path",
        "guessed_language",
        F.col("date_created").cast("string").alias("date_created_text"),
        F.col("date_updated").cast("string").alias("date_updated_text"),
    )


@query
def language_table(spark, sf_dir):
    """Labels appended to a stored table in two runs; the second finds only new files."""
    folder = scratch_path(spark, "languages")
    paths = _file_paths(spark, sf_dir).withColumn(
        "file_path", F.concat_ws("/", "host", "repo", "rel_path")
    )
    first = paths.filter(F.col("host") == "host0")
    for batch in (first, paths):
        fresh = languages.unlabelled(batch, tables.processed_paths(spark, folder))
        tables.append_languages(languages.label_files(fresh), folder, hostname="node-1")
    return tables.read_table(spark, folder, languages.GUESSED_LANGUAGES).select(
        "hosting_provider", "repo_name", "file_path", "guessed_language", "hostname"
    )


def _language_sizes(spark, sf_dir):
    return languages.language_sizes(languages.label_files(inputs.files(spark, sf_dir)))


@query
def language_top10(spark, sf_dir):
    return languages.top_languages(_language_sizes(spark, sf_dir))


def _map_text(entries):
    pairs = F.array_sort(F.map_entries(entries))
    return F.array_join(
        F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))),
        ",",
    )


@query
def language_map(spark, sf_dir):
    mapped = languages.language_map(_language_sizes(spark, sf_dir))
    return mapped.select("host", "repo", _map_text(F.col("languages")).alias("languages"))


# Metrics --------------------------------------------------------------------


def _sources(spark, sf_dir):
    """Files whose contents carry the texts of the documents. The texts of a large table stay
    in the tasks that read them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    name = "spread_docs"
    definition = inputs.SOURCES.replace("@documents", "{" + name + "}")
    return spark.sql(definition, **{name: _spread(docs, "doc_id")})


@query
def code_metrics(spark, sf_dir):
    return metrics.code_metrics(_sources(spark, sf_dir))


@query
def python_files(spark, sf_dir):
    labelled = languages.label_files(inputs.files(spark, sf_dir))
    return metrics.python_files(labelled).select("doc_id", "host", "repo", "dir", "name")


@query
def code_metrics_by_content(spark, sf_dir):
    """Every different content parsed once, looked up for all files that have it."""
    sources = _sources(spark, sf_dir)
    listed = content_metrics.listing(sources)
    measured_ = content_metrics.measure_listed(listed, content_metrics.contents_of(sources))
    return measured_.drop(content_metrics.DIGEST)


@query
def metrics_pending(spark, sf_dir):
    """Files that are left are found by their paths; only their contents are read."""
    done = derive(spark, sf_dir, inputs.LABELLED_PATHS)
    paths = inputs.sources(spark, sf_dir).select("file_path")
    waiting = metrics.unmeasured(paths, done)
    return metrics.code_metrics(content_metrics.contents_of(_sources(spark, sf_dir))(waiting))


@query
def metrics_append(spark, sf_dir):
    """Two runs over one stored table: the files of the labels table first, then what is left."""
    folder = scratch_path(spark, "metrics")
    sources = _sources(spark, sf_dir)
    listed = cut_lineage(content_metrics.listing(sources))
    earlier = derive(spark, sf_dir, inputs.LABELLED_PATHS)
    for batch in (listed.join(earlier, "file_path", "left_semi"), listed):
        analysis.append_measured(spark, batch, content_metrics.contents_of(sources), folder)
    return tables.read_table(spark, folder, CODE_METRICS)


@query
def metrics_rollup(spark, sf_dir):
    measured_ = code_metrics(spark, sf_dir).withColumn(
        "repo_no", F.regexp_extract("file_path", "[0-9]+", 0).cast("long") % 17
    )
    rolled = metrics.roll_up(measured_, ["repo_no"])
    return rolled.withColumn("avg_complexity", F.round("avg_complexity", 9))


@query
def stream_progress(spark, sf_dir):
    """Two runs of the stream: all files, then all again, of which some have changed."""
    base = scratch_path(spark, "stream")
    manifests = f"{base}/manifests"
    # A manifest per input split, but not more than some per core: the number of batches, each
    # with a cost of its own, does not follow how small the splits are.
    files_ = _sources(spark, sf_dir).select("file_path", "content").coalesce(4 * parallelism(spark))
    number = F.regexp_extract("file_path", "[0-9]+", 0).cast("long")
    more = F.when(number % 7 == 3, F.concat("content", F.lit("x = 1\n"))).otherwise(F.col("content"))
    for listed in (files_, files_.withColumn("content", more)):
        listed.write.mode("append").parquet(manifests)
        measure_stream(
            spark, manifests, f"{base}/metrics", f"{base}/checkpoint", files_per_batch=4
        ).awaitTermination()
    return measured(spark, f"{base}/metrics")


# API responses --------------------------------------------------------------


@query
def api_items(spark, sf_dir):
    return api_json.test_counts(derive(spark, sf_dir, inputs.SEARCH_RESPONSES))


@query
def api_latest_commit(spark, sf_dir):
    return api_json.latest_commits(derive(spark, sf_dir, inputs.COMMIT_RESPONSES))


@query
def commit_table_latest(spark, sf_dir):
    commits = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "user_id", "ts", "event_id", F.md5(F.col("event_id").cast("string")).alias("sha")
    )
    return api_json.latest_by_time(commits, "user_id", "sha", ["ts", "event_id"])


@query
def api_enrichment(spark, sf_dir):
    full = run_api_enrichment(
        _clean(spark, sf_dir),
        derive(spark, sf_dir, inputs.REPO_SEARCHES), derive(spark, sf_dir, inputs.REPO_COMMITS),
    )
    return full.select("row_id", "repo", "testfilecount", "last_commit_hash", "complete")


@query
def api_languages(spark, sf_dir):
    edges = api_json.language_edges(derive(spark, sf_dir, inputs.LANGUAGE_RESPONSES))
    pairs = F.map_entries("languages")
    as_text = F.array_join(
        F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))),
        ",",
    )
    return edges.select("repo", as_text.alias("languages"), "error")


# Measurements, scans, reports -----------------------------------------------


@query
def union_measurements(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "value", "event_type"
    )
    clicks = F.col("event_type") == "click"
    first = events.filter(clicks).withColumn("variant", F.lit("first"))
    second = events.filter(~clicks).withColumn("variant", F.lit("second"))
    return first.unionByName(second).select("event_id", "value", "variant")


@query
def tsv_scan(spark, sf_dir):
    """The registry written as ragged text in many parts, read back as one table."""
    folder = scratch_path(spark, "tsv")
    rows = inputs.registry(spark, sf_dir)
    line = F.concat_ws("\t", *REGISTRY_COLUMNS[:2], F.coalesce("repourl", F.lit("n/a")))
    rows.orderBy("row_id").select(line.alias("value")).write.text(folder)
    return tsv.read_registry(spark, folder, continuous=True)


@query
def tsv_rectangular(spark, sf_dir):
    folder = scratch_path(spark, "tsv")
    rows = inputs.registry(spark, sf_dir)
    fields = [F.coalesce(c, F.lit("")) for c in REGISTRY_COLUMNS]
    rows.orderBy("row_id").select(F.concat_ws("\t", *fields).alias("value")).write.text(folder)
    return tsv.read_rectangular(spark, folder, continuous=True)


@query
def csv_roundtrip(spark, sf_dir):
    folder = scratch_path(spark, "csv")
    tables.write_snapshot(_clean(spark, sf_dir), folder, "csv")
    return tables.read_csv(spark, folder, REGISTRY_CLEAN)


@query
def tree_scan(spark, sf_dir):
    """The files written as a tree, listed and read back."""
    root = scratch_path(spark, "repos").removeprefix("file://").removeprefix("file:")
    tree.write_tree(_file_paths(spark, sf_dir), root)
    listing = tree.list_tree(spark, root)
    texts = tree.read_contents(listing, root)
    return texts.select(
        "host",
        "repo",
        "rel_path",
        "suffix",
        F.octet_length("content").cast("long").alias("size"),
        F.md5("content").alias("content_md5"),
    )


@query
def tree_slice(spark, sf_dir):
    """Some files of one host of a tree; the scan opens no folder of another host."""
    root = scratch_path(spark, "repos").removeprefix("file://").removeprefix("file:")
    tree.write_tree(_file_paths(spark, sf_dir), root)
    found = tree_source.scan_tree(spark, root)
    return found.filter((F.col("host") == "host1") & F.col("suffix").isin(".py", ".c"))


@query
def text_reports(spark, sf_dir):
    """Listing of test files and error log, written as text and read back."""
    folder = scratch_path(spark, "reports")
    url = F.concat(F.lit("https://"), F.concat_ws("/", "host", "repo"))
    rows = _file_paths(spark, sf_dir).withColumn("repourl", url)
    repos = rows.select("repourl").distinct()
    reports.write_listing(files.listing_lines(files.list_test_files(rows), repos), folder)
    failed = rows.filter(F.col("name") == "README.md").select(
        "repourl", F.col("doc_id").cast("string").alias("error_message")
    )
    reports.write_errors(failed, folder)
    return spark.read.text(folder).groupBy(F.col("value").alias("line")).agg(
        F.count("*").alias("n")
    )


@query
def head_rows(spark, sf_dir):
    return inputs.registry(spark, sf_dir).orderBy("row_id").limit(31)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.build()


__all__ = ["analysis", "oracle_sql", "queries", "repositories_per_host"]
