"""Plain SQL definitions of the catalog queries, for comparison on another engine."""

from __future__ import annotations

from forgeatlas.functions import labels, urls
from forgeatlas.operators import content_language, enrich, files, hosts, languages, rdf
from forgeatlas.plans import inputs


def _text(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_S = "[A-Za-z][A-Za-z0-9+.\\-]*"
_REGISTRY = inputs.for_oracle(inputs.REGISTRY)
_FILES = inputs.for_oracle(inputs.FILES)
_SOURCES = inputs.for_oracle(inputs.SOURCES)
_TREES = inputs.for_oracle(inputs.TREE_REPOS)
_LABELLED = inputs.for_oracle(inputs.LABELLED_PATHS)


def _host(url: str) -> str:
    netloc = f"regexp_extract({url}, '^(?:{_S}:)?//([^/?#]*)', 1)"
    return (
        f"case when lower(regexp_extract({url}, '^({_S}):', 1)) in ({_text(urls.SUPPORTED_SCHEMES)}) "
        f"then nullif(lower(regexp_extract({netloc}, '^(?:.*@)?([^:]*)', 1)), '') end"
    )


_DIRECT = " or ".join(f"contains(u_netloc, '{h}')" for h in urls.DIRECT_PATH_HOSTS)

# The cleaning chain as CTEs; ends in "clean".
CLEAN = f"""
with registry as ({_REGISTRY}),
filled as (
  select row_id,
    last_value(projectref ignore nulls) over w as projectref,
    last_value(projectpage ignore nulls) over w as projectpage, repourl
  from registry window w as (order by row_id rows between unbounded preceding and current row)),
trimmed as (
  select row_id, projectref, projectpage,
    regexp_replace(regexp_replace(regexp_replace(repourl, '^\\++', ''), '/+$', ''), '^\\s+|\\s+$', '', 'g') as repourl
  from filled),
flagged as (
  select *, row_number() over (partition by projectref, projectpage, repourl order by row_id) > 1 as duplicate_flag
  from trimmed),
nulls as (
  select *, not duplicate_flag and (projectref is null or projectpage is null or repourl is null) as null_value_flag
  from flagged),
upgraded as (select * replace (regexp_replace(repourl, '^http\\b', 'https') as repourl) from nulls),
hosted as (
  select *, case when not duplicate_flag then {_host('repourl')} end as repodomain from upgraded),
checked as (
  select *, repodomain is null as unsupported_url_scheme,
    duplicate_flag or repodomain is null or coalesce(len(string_split(repourl, '/')) < {urls.EXPECTED_URL_PARTS}, true) as incomplete_url_flag
  from hosted),
cut as (
  select *, lower(regexp_extract(repourl, '^({_S}):', 1)) as u_scheme,
    regexp_extract(repourl, '^(?:{_S}:)?//([^/?#]*)', 1) as u_netloc,
    trim(regexp_replace(regexp_extract(repourl, '^(?:{_S}:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', ''), '/') as u_path
  from checked),
based as (
  select *, case
      when duplicate_flag or unsupported_url_scheme or incomplete_url_flag then null
      when {_DIRECT} then u_path
      when len(string_split(u_path, '/')) >= 2 then array_to_string(list_slice(string_split(u_path, '/'), 1, 2), '/')
    end as u_base
  from cut),
clean as (
  select row_id, projectref, projectpage, repourl, duplicate_flag, null_value_flag, repodomain,
    unsupported_url_scheme, incomplete_url_flag,
    u_scheme || '://' || u_netloc || '/' || u_base as base_repo_url,
    case when not (duplicate_flag or unsupported_url_scheme or incomplete_url_flag) then u_base is null end as base_repo_url_flag
  from based)
"""

_EXPLANATION = f"""
  coalesce(nullif(concat_ws('{enrich.TEXT_SEPARATOR}',
    case when duplicate_flag then '{enrich.TEXT_DUPLICATE}'
         when null_value_flag then '{enrich.TEXT_NULL}'
         when unsupported_url_scheme then '{enrich.TEXT_UNSUPPORTED}'
         when incomplete_url_flag then
           case when len(string_split(repourl, '/')) < {urls.EXPECTED_URL_PARTS} then
             replace('{enrich.TEXT_INCOMPLETE}', '%d', cast({urls.EXPECTED_URL_PARTS} - len(string_split(repourl, '/')) as varchar)) end
         when coalesce(base_repo_url_flag, false) then '{enrich.TEXT_BASE_FAILED}'
         when clone_status = 'failed' then '{enrich.TEXT_CLONE_FAILED}'
         when clone_status is null then '{enrich.TEXT_CLONE_UNKNOWN}' end,
    case when clone_status = 'successful' and testfilecountlocal = -1 then '{enrich.TEXT_NOT_COUNTED}' end,
    case when clone_status = 'successful' and last_commit_hash is null then '{enrich.TEXT_NO_HASH}' end), ''),
    '{enrich.TEXT_NONE}') as explanation
"""

ENRICHED = f"""{CLEAN},
enriched as (select *, {inputs.ENRICHMENT} from clean),
explained as (select *, {_EXPLANATION} from enriched),
staged as (
  select *,
    case when duplicate_flag then null
         when incomplete_url_flag then '{labels.INCOMPLETE}'
         when clone_status = 'failed' then '{labels.NOT_CLONED}'
         when clone_status = 'successful' then '{labels.CLONED}' end as stage,
    case when JUnit_file_patterns + pytest_file_patterns + Mocha_file_patterns = 0 then '{labels.NO_RUNNER}'
         when JUnit_file_patterns >= pytest_file_patterns and JUnit_file_patterns >= Mocha_file_patterns then 'JUnit'
         when pytest_file_patterns >= Mocha_file_patterns then 'pytest' else 'Mocha' end as runner,
    case when testfilecountlocal <= -1 then null when testfilecountlocal = 0 then '{labels.BUCKETS[0]}'
         when testfilecountlocal <= 9 then '{labels.BUCKETS[1]}' when testfilecountlocal <= 99 then '{labels.BUCKETS[2]}'
         when testfilecountlocal <= 999 then '{labels.BUCKETS[3]}' else '{labels.BUCKETS[4]}' end as bucket
  from enriched),
host_n as (select repodomain, count(*) as n, min(row_id) as f from clean where repodomain is not null group by repodomain),
nodes as (
  select position - 1 as node_id, label from (values {", ".join(f"({i + 1}, '{v}')" for i, v in enumerate(labels.FIXED_NODES))}) t(position, label)
  union all
  select {len(labels.FIXED_NODES) - 1} + row_number() over (order by n desc, f), repodomain from host_n where n > {hosts.BIG_HOST_GT}),
ends as (
  select s.*, case when h.n > {hosts.BIG_HOST_GT} then s.repodomain when h.n is not null then '{labels.SMALL_HOSTS}' end as host_node
  from staged s left join host_n h using (repodomain)),
pairs as (
  select '{labels.ORIGINAL}' as a, host_node as b from ends where host_node is not null
  union all select '{labels.ORIGINAL}', '{labels.DUPLICATES}' from ends where duplicate_flag
  union all select host_node, stage from ends where host_node is not null and stage is not null
  union all select '{labels.CLONED}', runner from ends where clone_status = 'successful'
  union all select runner, bucket from ends where clone_status = 'successful' and bucket is not null),
sums as (select a, b, count(*) as v from pairs group by a, b
  union all select '{labels.ORIGINAL}', '{labels.SMALL_HOSTS}', 0
    where not exists (select 1 from pairs where b = '{labels.SMALL_HOSTS}')),
links as (
  select cast(x.node_id as int) as source, cast(y.node_id as int) as target, v as value
  from sums join nodes x on x.label = a join nodes y on y.label = b)
"""

_SUFFIX = "regexp_extract(name, '.(\\.[^.]+)$', 1)"
_KEY = (
    "case when not (duplicate_flag or unsupported_url_scheme or incomplete_url_flag or coalesce(base_repo_url_flag, false)) "
    "then regexp_replace(repodomain, '[^\\p{L}\\p{N}_-]', '_', 'g') || '/' || "
    "regexp_replace(string_split(repourl, '/')[-1], '(.)\\.[^.]+$', '\\1') end"
)
_IS_TEST = (
    "(contains(lower(name), 'test') or contains(lower(host || '/' || repo || '/' || dir), 'test')) "
    f"and {_SUFFIX} not in ({{}})"
)
_TEST = _IS_TEST.format(_text(files.EXCLUDED))
_TEST_SEARCH = _IS_TEST.format(_text(files.SEARCH_EXCLUDED))

_LANG = (
    "case when content is null then 'Unknown' "
    + " ".join(
        f"when name = '{n}' then '{v}'" for n, v in languages.LANGUAGE_BY_NAME.items()
    )
    + " "
    + " ".join(
        f"when lower({_SUFFIX}) = '{s}' then '{v}'"
        for s, v in languages.LANGUAGE_BY_SUFFIX.items()
    )
    + " else 'Unknown' end"
)

# Counts of byte 1- to 3-grams, their weights per language, and the sums of every file.
_LEARNED = f"""
with files as (select *, {_SUFFIX} as suffix from ({inputs.for_oracle(inputs.UNTOLD)})),
bytes as (select doc_id, language, hex(encode(content)) as h from files where content is not null),
grams as (
  select doc_id, language, g, count(*) as n from (
    select doc_id, language, unnest([substr(h, 2 * i - 1, 2 * k) for i in range(1, (len(h) // 2 - k + 2)::bigint)]) as g
    from bytes, (values (1), (2), (3)) t(k) where len(h) // 2 >= k)
  group by all),
learned as (select language, g, sum(n) as n from grams where language is not null group by all),
taught as (select * from files where language is not null and content is not null),
facts as (
  select language, count(*) as files, coalesce(any_value(gn), 0) as grams,
    (select count(distinct g) from learned) as variety, (select count(distinct suffix) from taught) as suffixes,
    (select count(*) from (select name from taught group by name having count(*) >= {{names}})) as names,
    (select count(*) from taught) as all_files
  from taught left join (select language, sum(n) as gn from learned group by 1) using (language) group by language),
sums as (
  select doc_id, f.language, sum(t.n * (round(1000 * ln((l.n + 1) / (f.grams + f.variety)))
    - round(1000 * ln(1 / (f.grams + f.variety))))) as gained
  from (select doc_id, g, n from grams) t join learned l using (g) join facts f on f.language = l.language group by all),
totals as (select doc_id, sum(n) as many from grams group by 1),
scored as (
  select d.doc_id, f.language, cast(round(1000 * ln(f.files / f.all_files))
    + coalesce(t.many, 0) * round(1000 * ln(1 / (f.grams + f.variety))) + coalesce(s.gained, 0)
    + round(1000 * ln((1 + (select count(*) from taught x where x.language = f.language and x.suffix = d.suffix)) / (f.files + f.suffixes)))
    + round(1000 * ln((1 + case when (select count(*) from taught x where x.name = d.name) >= {{names}}
        then (select count(*) from taught x where x.language = f.language and x.name = d.name) else 0 end) / (f.files + f.names)))
    as bigint) as score
  from files d cross join facts f left join sums s on s.doc_id = d.doc_id and s.language = f.language
    left join totals t on t.doc_id = d.doc_id where d.content is not null)
select f.doc_id, b.language, b.score from files f left join (
  select * from (select *, row_number() over (partition by doc_id order by score desc, language) as r from scored) where r = 1
) b on b.doc_id = f.doc_id
"""

_RULES = {
    "dependency_patterns": [
        ("JUnit", "org.junit.jupiter:junit-jupiter"),
        ("JUnit", "junit:junit"),
        ("Mocha", "mocha"),
    ],
    "config_files": [
        ("JUnit", "pom.xml"), ("JUnit", "build.gradle"), ("pytest", "pytest.ini"),
        ("pytest", "tox.ini"), ("pytest", "pyproject.toml"), ("Mocha", "package.json"),
        ("Mocha", ".mocharc.json"), ("Mocha", ".mocharc.js"),
    ],
    "file_patterns": [
        ("JUnit", ".*Test.java"), ("pytest", "test_.*.py"), ("pytest", ".*_test.py"),
        ("Mocha", "test/.*.js"),
    ],
}


def _rules(kind: str) -> str:
    rows = ", ".join(f"('{r}', '{p}')" for r, p in _RULES[kind])
    return f"(values {rows}) {kind}(runner, pattern)"


_HITS = f"""
with files as ({_FILES}),
config_files as (select host, repo, dir, name, content, runner, pattern from files join {_rules('config_files')} on name = pattern),
file_patterns as (select host, repo, dir, name, runner, pattern from files join {_rules('file_patterns')} on regexp_matches(name, '^(?:' || pattern || ')')),
dependency_patterns as (
  select host, repo, dir, name, c.runner, d.pattern from config_files c
  join {_rules('dependency_patterns').replace(') dependency', ') d').replace('d_patterns', 'd')} on c.runner = d.runner and contains(content, d.pattern))
"""

_ALL_HITS = " union all ".join(
    f"select host, repo, runner || '_{kind}' as c from {kind}" for kind in _RULES
)
_COUNTERS = ", ".join(
    f"count(*) filter (where c = '{r}_{k}') as {r}_{k}"
    for r in labels.RUNNERS
    for k in ("dependency_patterns", "config_files", "file_patterns")
)
_EVIDENCE = f"""{_HITS},
hits as ({_ALL_HITS} union all select distinct host, repo, null from files)
select host, repo, {_COUNTERS} from hosts_hits group by host, repo
""".replace("hosts_hits", "hits")

_ROW_TRIPLES = " union all ".join(
    f"""select row_id, '{inputs.PROJECT_BASE}' || coalesce(projectref, '{rdf.MISSING_REFERENCE}') as s,
    '{inputs.PROJECT_BASE}{c}' as p, cast({c} as varchar) as o,
    case when starts_with(cast({c} as varchar), 'http') then 'uri' else 'literal' end as o_kind,
    case when not starts_with(cast({c} as varchar), 'http') then '{rdf.XSD_STRING}' end as o_datatype
  from explained where {c} is not null{f" and {c} <> {rdf.NOT_COUNTED[c]}" if c in rdf.NOT_COUNTED else ""}"""
    for c in rdf.ROW_COLUMNS
)
_OBS = "https://github.com/example/project/"
_OBSERVATIONS = inputs.for_oracle(inputs.OBSERVATIONS)
_OBS_SUBJECT = f"'{_OBS}' || CommitHash || '/' || MethodUsed"
_V = rdf.OBSERVATION_VOCABULARY
_OBS_TRIPLES = f"""
select {_OBS_SUBJECT} as s, '{rdf.RDF_TYPE}' as p, '{_V}Observation' as o, 'uri' as o_kind, cast(null as varchar) as o_datatype from obs
union all select {_OBS_SUBJECT}, '{_V}commit', '{_OBS}commit/' || CommitHash, 'uri', null from obs
union all select {_OBS_SUBJECT}, '{_V}methodUsed', '{_V}' || MethodUsed, 'uri', null from obs
union all select {_OBS_SUBJECT}, '{_V}testFileCount', cast(TestFileCount as varchar), 'literal', '{rdf.XSD_INTEGER}' from obs
"""

_METRICS = """
select file_path,
  case when bad or k = 0 then -1 else k end as num_test_cases,
  -1 as num_assertions,
  case when bad then -1 else k end as assert_statements,
  not bad as has_setup, false as has_teardown,
  case when bad or k = 0 then -1 else 2 * k end as complexity,
  case when bad then -1 else 1 + 5 * m + (case when k > 0 then 2 else 0 end) end as cyclomatic_complexity,
  case when bad then -1 else k + 1 + 3 + 7 * m + 4 * k end as lines_of_code,
  case when bad then -1 else 1 + m + (case when k > 0 then 1 else 0 end) end as num_functions,
  case when bad then 'Could not parse file: ' || file_path end as analysis_error
from (select 'src/' || doc_id || case when doc_id % 11 = 5 then '.txt' else '.py' end as file_path,
    doc_id % 13 = 0 or doc_id % 11 = 5 as bad,
    len(string_split(coalesce(text, ''), chr(10))) - 1 as k, length(coalesce(text, '')) % 2 as m
  from documents)
"""
_METRICS_TYPED = f"""
select file_path, cast(num_test_cases as bigint) as num_test_cases, cast(num_assertions as bigint) as num_assertions,
  cast(assert_statements as bigint) as assert_statements, has_setup, has_teardown, cast(complexity as bigint) as complexity,
  cast(cyclomatic_complexity as bigint) as cyclomatic_complexity, cast(lines_of_code as bigint) as lines_of_code,
  cast(num_functions as bigint) as num_functions, analysis_error from ({_METRICS})
"""

_LANG_SIZES = f"""
with files as ({_FILES}),
sizes as (select host, repo, {_LANG} as guessed_language, cast(sum(size) as bigint) as size from files group by all)
"""

_OLD_NEW = f"""
with labelled as ({_LABELLED}),
newer as (select doc_id, 'src/' || doc_id || '.py' as file_path, {_LANG} as guessed_language from ({_FILES}))
select n.file_path, n.guessed_language,
  '2024-01-01 00:00:00' as date_created_text, '2024-06-01 00:00:00' as date_updated_text
from newer n semi join labelled l on n.file_path = l.file_path
union all
select n.file_path, n.guessed_language, '2024-03-01 00:00:00', '2024-03-01 00:00:00'
from newer n anti join labelled l on n.file_path = l.file_path
"""


def build() -> dict[str, str]:
    sql: dict[str, str] = {}

    # Registry ------------------------------------------------------------
    sql["registry_clean"] = f"{CLEAN} select * from clean"
    sql["registry_ffill"] = f"{CLEAN} select * from filled"
    sql["registry_dup_flag"] = f"{CLEAN} select row_id, duplicate_flag from flagged"
    sql["registry_null_flag"] = f"{CLEAN} select row_id, null_value_flag from nulls"
    sql["url_trim_https"] = f"{CLEAN} select row_id, repourl from upgraded"
    sql["url_canonical"] = """
      select page_id, regexp_replace(regexp_replace(url, '/+$', ''), 'https?://(www\\.)?', 'https://', 'g') as url from pages"""
    sql["url_owner_repo"] = f"""{CLEAN} select row_id,
      case when list_position(string_split(repourl, '/'), 'github.com') > 0 then
        case when len(string_split(repourl, '/')) >= list_position(string_split(repourl, '/'), 'github.com') + 2 then
          array_to_string(list_slice(string_split(repourl, '/'), list_position(string_split(repourl, '/'), 'github.com') + 1,
            list_position(string_split(repourl, '/'), 'github.com') + 2), '/') else '' end end as owner_repo
      from upgraded"""
    sql["url_repo_name"] = f"""{CLEAN} select row_id,
      regexp_replace(string_split(repourl, '/')[-1], '(.)\\.[^.]+$', '\\1') as repo_name, {_KEY} as repo_key from clean"""
    sql["sanitise"] = """
      select page_id, regexp_replace(url, '[^\\p{L}\\p{N}_-]', '_', 'g') as safe_name from pages"""
    sql["url_domain"] = f"select page_id, {_host('url')} as domain from pages"
    sql["url_flags"] = f"{CLEAN} select row_id, repodomain, unsupported_url_scheme, incomplete_url_flag from checked"
    sql["base_repo_url"] = f"{CLEAN} select row_id, base_repo_url, base_repo_url_flag from clean"
    sql["quality_profile"] = f"""{CLEAN} select count(*) as total_rows,
      count(*) filter (where duplicate_flag) as duplicates, count(*) filter (where null_value_flag) as null_rows,
      count(*) filter (where unsupported_url_scheme and not duplicate_flag) as unsupported,
      count(*) filter (where incomplete_url_flag) as incomplete,
      count(*) filter (where base_repo_url_flag) as base_url_failures from clean"""
    profiled = [("row_id", "bigint"), ("projectref", "string"), ("projectpage", "string"), ("repourl", "string")]
    sql["table_profile"] = f"with registry as ({_REGISTRY}) " + " union all ".join(
        f"select '{c}' as column_name, '{t}' as column_type, count(*) as row_count, count({c}) as non_null from registry"
        for c, t in profiled
    )

    # Hosts ---------------------------------------------------------------
    sql["host_counts"] = f"{CLEAN} select repodomain, count(repodomain) as n, min(row_id) as first_row_id from clean group by repodomain"
    sql["host_split"] = f"""{CLEAN} select repodomain, count(*) as n, min(row_id) as first_row_id, count(*) > {hosts.BIG_HOST_GT} as is_big
      from clean where repodomain is not null group by repodomain"""
    sql["small_host_total"] = f"""{CLEAN} select cast(coalesce(sum(n), 0) as bigint) as small_total from
      (select count(*) as n from clean where repodomain is not null group by repodomain) where n <= {hosts.BIG_HOST_GT}"""
    sql["small_host_rows"] = f"""{CLEAN} select row_id, repodomain from
      (select row_id, repodomain, count(*) over (partition by repodomain) as n from clean where repodomain is not null)
      where n <= {hosts.BIG_HOST_GT}"""
    sql["distinct_hosts"] = f"{CLEAN} select distinct repodomain from clean"
    sql["top_hosts"] = f"""{CLEAN} select repodomain, count(*) as n, min(row_id) as first_row_id
      from clean where repodomain is not null group by repodomain"""
    sql["host_report"] = f"""{CLEAN} select row_number() over (order by n desc nulls first, f) - 1 as line_no, line from (
        select null as n, null as f, '{hosts.REPORT_HEADER}' as line
        union all select count(repodomain), min(row_id), coalesce(repodomain, 'None') || ': ' || count(repodomain) from clean group by repodomain)"""
    sql["host_buckets"] = f"""{CLEAN} select row_id, case when n >= {hosts.MIN_ROWS} then regexp_replace(repodomain, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g')
        else '{hosts.OTHER}' end as bucket
      from (select row_id, repodomain, count(*) over (partition by repodomain) as n from clean where repodomain is not null)"""
    sql["per_host_tables"] = f"""{CLEAN} select bucket, count(*) as n, cast(sum(row_id) as bigint) as row_ids from (
        select row_id, case when count(*) over (partition by repodomain) >= {hosts.MIN_ROWS} then regexp_replace(repodomain, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g')
        else '{hosts.OTHER}' end as bucket from clean where repodomain is not null) group by bucket"""
    sql["host_slice"] = f"""{CLEAN}, n as (select repodomain, count(*) as n from clean where repodomain is not null group by repodomain),
      ends as ((select repodomain from n order by n desc, repodomain limit 1) union all (select repodomain from n order by n, repodomain limit 1))
      select row_id, repodomain, repourl from ends join clean using (repodomain)"""
    sql["null_host_rows"] = f"{CLEAN} select row_id, repourl from clean where repodomain is null"

    # Files and runners ---------------------------------------------------
    sql["path_parts"] = f"""with files as ({_FILES}) select doc_id, dir || '/' || name as rel_path, name, dir,
      {_SUFFIX} as suffix from files"""
    sql["test_file_count"] = f"with files as ({_FILES}) select host, repo, count(*) filter (where {_TEST}) as testfilecountlocal from files group by host, repo"
    sql["test_file_count_search"] = sql["test_file_count"].replace(_TEST, _TEST_SEARCH)
    sql["test_file_list"] = f"with files as ({_FILES}) select host, repo, dir, name from files where {_TEST}"
    sql["tree_profile"] = f"""with files as ({_FILES}) select host, count(distinct repo) as repositories, count(*) as files
      from files group by host"""
    for kind, key in (("config_files", "config_hits"), ("file_patterns", "pattern_hits"), ("dependency_patterns", "dependency_hits")):
        sql[f"runner_{key}"] = f"{_HITS} select host, repo, dir, name, runner, pattern from {kind}"
    sql["runner_rules_many"] = f"""select distinct host, repo, dir, name, runner, pattern
      from ({inputs.for_oracle(inputs.NAMED_FILES)}) f join ({inputs.for_oracle(inputs.NAME_RULES)}) r
        on regexp_matches(name, '^(?:' || pattern || ')')"""
    sql["runner_evidence"] = _EVIDENCE

    # Enrichment ----------------------------------------------------------
    sql["processable"] = f"""{CLEAN} select row_id, repourl from clean where not duplicate_flag and not unsupported_url_scheme
      and not incomplete_url_flag and not coalesce(base_repo_url_flag, false) and coalesce(repourl, '') <> ''"""
    done = f"""keyed as (select *, {_KEY} as repo_key from enriched),
      done as (select distinct repo_key from keyed where testfilecountlocal <> -1 and last_commit_hash is not null and repo_key is not null)"""
    sql["resume_pending"] = f"""{ENRICHED}, {done}
      select row_id, repo_key from keyed k where repo_key is not null and not exists (select 1 from done d where d.repo_key = k.repo_key)"""
    sql["progress"] = f"""{ENRICHED} select count(*) as total, count(*) filter (where testfilecountlocal <> -1) as complete,
      count(*) filter (where testfilecountlocal = -1) as left_to_do from enriched"""
    sql["key_collisions"] = f"""{CLEAN}, keyed as (select *, {_KEY} as repo_key from clean)
      select repo_key, count(distinct repourl) as urls, count(*) as rows from keyed where repo_key is not null
      group by repo_key having count(distinct repourl) > 1"""
    sql["match_tree"] = f"""{CLEAN}, keyed as (select *, {_KEY} as repo_key from clean),
      trees as ({_TREES})
      select row_id, repo_key from keyed where repo_key in (select repo_key from trees)"""
    sql["writeback"] = f"""{CLEAN}, keyed as (select *, {_KEY} as repo_key from clean),
      results as ({_TREES})
      select row_id, k.repo_key, coalesce(r.testfilecountlocal, -1) as testfilecountlocal,
        case when r.repo_key is not null then 'successful' end as clone_status
      from keyed k left join results r on k.repo_key = r.repo_key"""
    failed = f"failed as (select repo_key, max(error_message) as error_message from ({inputs.for_oracle(inputs.FAILED_REPOS)}) group by 1)"
    sql["enrich_failures"] = f"""{CLEAN}, keyed as (select *, {_KEY} as repo_key from clean),
      results as ({_TREES}), {failed}
      select row_id, k.repo_key, coalesce(r.testfilecountlocal, -1) as testfilecountlocal,
        case when r.repo_key is not null then 'successful'
             when f.repo_key is not null then 'failed' end as clone_status
      from keyed k left join results r on k.repo_key = r.repo_key
        left join failed f on k.repo_key = f.repo_key"""
    sql["failure_log"] = f"""{CLEAN}, keyed as (select *, {_KEY} as repo_key from clean), {failed}
      select row_id, k.repo_key, error_message
      from keyed k join failed f on k.repo_key = f.repo_key"""
    sql["explanations"] = f"{ENRICHED} select row_id, explanation from explained"

    # Flow graph ----------------------------------------------------------
    sql["test_bucket"] = f"{ENRICHED} select row_id, bucket as test_file_category from staged"
    sql["primary_runner"] = f"""{ENRICHED} select row_id, runner as primary_runner, JUnit_file_patterns as JUnit_total,
      pytest_file_patterns as pytest_total, Mocha_file_patterns as Mocha_total,
      case when JUnit_file_patterns = 0 and pytest_file_patterns = 0 and Mocha_file_patterns = 0 then 1 else 0 end as No_test_runner_detected from staged"""
    sql["cloned_rows"] = f"{ENRICHED} select row_id from enriched where clone_status = 'successful'"
    sql["flow_nodes"] = f"{ENRICHED} select cast(node_id as int) as node_id, label from nodes"
    sql["flow_links"] = f"{ENRICHED} select source, target, value from links"

    # RDF -----------------------------------------------------------------
    good = f"{ENRICHED}, triples as ({_ROW_TRIPLES}), bad as (select distinct row_id from triples where o_kind = 'uri' and regexp_matches(o, '[<>\" {{}}|\\\\^`]'))"
    sql["row_triples"] = f"{good} select * from triples where row_id not in (select row_id from bad)"
    sql["triple_count"] = f"""{good} select count(*) as statements from
      (select distinct s, p, o, o_kind, o_datatype from triples where row_id not in (select row_id from bad))"""
    sql["observation_triples"] = f"with obs as ({_OBSERVATIONS}) {_OBS_TRIPLES}"
    sql["observation_graph"] = f"with obs as ({_OBSERVATIONS}) select distinct * from ({_OBS_TRIPLES})"
    sql["ntriples_scan"] = f"{good} select distinct s, p, o, o_kind, o_datatype from triples where row_id not in (select row_id from bad)"

    sql["turtle_scan"] = sql["ntriples_scan"]
    sql["rejected_documents"] = f"{good} select row_id from bad"

    # Languages -----------------------------------------------------------
    sql["language_label"] = f"with files as ({_FILES}) select doc_id, {_LANG} as guessed_language from files"
    sql["language_model_hook"] = f"""with files as ({_FILES}) select doc_id, case when contains(content, 'junit:junit') then 'XML'
      when contains(content, 'devDependencies') then 'JSON' else 'Unknown' end as guessed_language from files"""
    sql["language_content"] = _LEARNED.format(names=content_language.NAME_FILES)
    firsts = [
        ("^#![^\n]*\\bpython", "Python"), ("^#![^\n]*\\b(ba|z|da|k)?sh\\b", "Shell"), ("^#![^\n]*\\bperl", "Perl"),
        ("^#![^\n]*\\bruby", "Ruby"), ("^#![^\n]*\\bnode", "JavaScript"), ("^\\s*<\\?php", "PHP"),
        ("^\\s*<\\?xml", "XML"), ("^\\s*<!doctype html", "HTML"),
    ]
    found = " ".join(f"when regexp_matches(content, '{p}', 'i') then '{v}'" for p, v in firsts)
    sql["language_patterns"] = f"""select doc_id, case when content is null then 'Unknown' {found} else 'Unknown' end as guessed_language
      from ({inputs.for_oracle(inputs.HEADED)})"""
    sql["language_pending"] = f"with s as ({_SOURCES}), labelled as ({_LABELLED}) select doc_id, file_path from s where file_path not in (select file_path from labelled)"
    sql["language_upsert"] = _OLD_NEW
    sql["language_table"] = f"""with files as ({_FILES}) select host as hosting_provider, repo as repo_name,
      host || '/' || repo || '/' || dir || '/' || name as file_path, {_LANG} as guessed_language, 'node-1' as hostname from files"""
    sql["language_top10"] = f"""{_LANG_SIZES} select host, repo, guessed_language, size, cast(r as int) as rank from
      (select *, row_number() over (partition by host, repo order by size desc, guessed_language) as r from sizes) where r <= 10"""
    sql["language_map"] = f"""{_LANG_SIZES} select host, repo,
      string_agg(guessed_language || '=' || size, ',' order by guessed_language) as languages from sizes group by host, repo"""

    # Metrics -------------------------------------------------------------
    sql["code_metrics"] = _METRICS_TYPED
    sql["python_files"] = f"""with files as ({_FILES}) select doc_id, host, repo, dir, name from files
      where {_LANG} = 'Python'"""
    sql["metrics_pending"] = f"{_METRICS_TYPED} where file_path not in ({_LABELLED})"
    sql["metrics_append"] = _METRICS_TYPED
    sql["metrics_rollup"] = f"""with m as (select *, cast(regexp_extract(file_path, '[0-9]+') as bigint) % 17 as repo_no from ({_METRICS}))
      select repo_no, count(*) as files, count(analysis_error) as failed_files,
        cast(sum(case when lines_of_code > 0 then lines_of_code else 0 end) as bigint) as lines_of_code,
        cast(sum(case when num_functions > 0 then num_functions else 0 end) as bigint) as functions,
        cast(sum(case when num_functions > 0 then cyclomatic_complexity else 0 end) as bigint) as complexity,
        round(case when sum(case when num_functions > 0 then num_functions else 0 end) > 0 then
          sum(case when num_functions > 0 then cyclomatic_complexity else 0 end) / sum(case when num_functions > 0 then num_functions else 0 end)
          else 0.0 end, 9) as avg_complexity
      from m group by repo_no"""
    sql["code_metrics_by_content"] = _METRICS_TYPED
    sql["stream_progress"] = f"""select * replace (case when analysis_error is null and
        cast(regexp_extract(file_path, '[0-9]+') as bigint) % 7 = 3 then lines_of_code + 1 else lines_of_code end as lines_of_code)
      from ({_METRICS_TYPED})"""

    # API responses -------------------------------------------------------
    sql["api_items"] = """select user_id as repo, count(*) filter (where event_id % 40 <> 0) as testfilecount,
      count(*) filter (where event_id % 40 = 0) as bad_pages from events group by user_id"""
    sql["api_latest_commit"] = """select event_id as repo, case when event_id % 40 <> 0 then md5(cast(event_id as varchar)) end as sha,
      case when event_id % 40 <> 0 then 'https://github.com/o/r/commit/' || event_id end as html_url from events"""
    sql["commit_table_latest"] = """select user_id as repo, md5(cast(event_id as varchar)) as sha from
      (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1"""
    sql["api_enrichment"] = f"""with p as ({sql["processable"]}),
      parts as (select row_id, string_split(repourl, '/') as s, list_position(string_split(repourl, '/'), 'github.com') as spot from p),
      named as (select row_id, case when spot > 0 and len(s) >= spot + 2 then s[spot + 1] || '/' || s[spot + 2] end as repo from parts),
      counts as (select repo, coalesce(sum(case when body like '%items%' then 2 end), 0) as n, count(*) filter (where body not like '%items%') as bad
        from ({inputs.for_oracle(inputs.REPO_SEARCHES)}) group by 1),
      commits as (select repo, max(substr(body, 10, 32)) as sha from ({inputs.for_oracle(inputs.REPO_COMMITS)}) where body <> '[]' group by 1)
      select row_id, n.repo, coalesce(c.n, -1)::bigint as testfilecount, k.sha as last_commit_hash,
        coalesce(c.bad = 0 and k.sha is not null, false) as complete
      from named n left join counts c on n.repo = c.repo left join commits k on n.repo = k.repo"""
    sql["api_languages"] = """select event_id as repo,
      case when event_id % 50 <> 0 then event_type || '=' || user_id || ',C=1' end as languages,
      case when event_id % 50 = 0 then 'Query failed to run by returning code of 502. Bad Gateway' end as error from events"""

    # Measurements, scans, reports ----------------------------------------
    sql["union_measurements"] = """select event_id, value, 'first' as variant from events where event_type = 'click'
      union all select event_id, value, 'second' from events where event_type <> 'click'"""
    sql["tsv_scan"] = f"""with registry as ({_REGISTRY}),
      filled as (select row_number() over (order by row_id) - 1 as row_id,
        last_value(projectref ignore nulls) over w as projectref,
        last_value(projectpage ignore nulls) over w as projectpage, coalesce(repourl, 'n/a') as repourl
      from registry window w as (order by row_id rows between unbounded preceding and current row))
      select * from filled"""
    sql["tsv_rectangular"] = sql["tsv_scan"].replace("coalesce(repourl, 'n/a') as repourl", "repourl")
    sql["csv_roundtrip"] = f"{CLEAN} select * from clean"
    sql["tree_scan"] = f"""with files as ({_FILES}) select host, repo, dir || '/' || name as rel_path, {_SUFFIX} as suffix,
      cast(strlen(content) as bigint) as size, md5(content) as content_md5 from files"""
    sql["tree_slice"] = f"""with files as ({_FILES}) select host, repo, dir || '/' || name as rel_path, dir, name, {_SUFFIX} as suffix,
      cast(coalesce(strlen(content), 0) as bigint) as size from files where host = 'host1' and {_SUFFIX} in ('.py', '.c')"""
    sql["text_reports"] = f"""with files as ({_FILES}), lines as (
        select 'Repository URL: https://' || host || '/' || repo as line from files group by host, repo
        union all select '' from files group by host, repo
        union all select dir || '/' || name from files where {_TEST}
        union all select l from (select unnest(['Repository URL: https://' || host || '/' || repo, 'Error Message: ' || doc_id, '']) as l
          from files where name = 'README.md'))
      select line, count(*) as n from lines group by line"""
    sql["head_rows"] = f"with registry as ({_REGISTRY}) select * from registry order by row_id limit 31"
    return sql
