"""Inputs of the query catalog, derived from the given tables.

Each definition is one text that Spark and a SQL engine read alike; ``@name``
stands for a table. ``chr(10)`` is the line feed in both dialects.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Subjects of the row statements.
PROJECT_BASE = "https://registry.example.org/project/"

REGISTRY = """
with base as (
  select page_id * 2 as row_id, page_id, case page_id % 11
    when 1 then replace(url, 'http', 'ftp')
    when 2 then null
    when 3 then concat('+', url, '/')
    when 4 then regexp_extract(url, '^https?://[^/]+', 0)
    when 5 then replace(replace(url, 'https://', 'HTTPS://User@'), 'http://', 'HTTP://')
    when 6 then replace(url, '.com/', '.com:8080/')
    when 7 then concat('https://gitlab.com/group/sub/', cast(page_id as string))
    when 8 then concat('https://github.com/owner', cast(page_id % 5 as string), '/repo', cast(page_id % 3 as string), '.git')
    else url end as repourl,
    page_id % 3 = 0 as is_header
  from @pages),
allrows as (
  select row_id, page_id, repourl, is_header from base
  union all
  select row_id + 1, page_id, repourl, false from base where page_id % 7 = 0)
select row_id,
  case when is_header then concat('P', cast(page_id as string)) end as projectref,
  case when is_header then concat('https://registry.example.org/project/P', cast(page_id as string)) end as projectpage,
  repourl
from allrows
"""

FILES = """
select doc_id,
  concat('host', cast(doc_id % 3 as string)) as host,
  concat('repo', cast(doc_id % 17 as string)) as repo,
  case when doc_id % 4 = 0 then concat('tests/', cast(doc_id as string)) else concat('src/', cast(doc_id as string)) end as dir,
  case doc_id % 10 when 0 then 'test_a.py' when 1 then 'a_test.py' when 2 then 'FooTest.java' when 3 then 'package.json'
    when 4 then 'pom.xml' when 5 then 'pytest.ini' when 6 then 'README.md' when 7 then 'main.c' when 8 then '__init__.py'
    else 'test_b_test.py' end as name,
  case when doc_id % 20 = 3 then concat('{"devDependencies":{"mocha":"1"}} ', text)
       when doc_id % 20 = 4 then concat('<dependency>junit:junit</dependency> ', text) else text end as content,
  n_chars as size
from @documents
"""

# Files whose names do not tell their language; two thirds of the documents with a language
# teach it, and some texts begin like a script or a page.
UNTOLD = """
select doc_id, text as content,
  concat('page', cast(doc_id % 7 as string), case when doc_id % 5 = 0 then '' else '.txt' end) as name,
  case when doc_id % 3 <> 1 then lang end as language
from @documents
"""

HEADED = """
select doc_id, concat('file', cast(doc_id as string)) as name, concat(case doc_id % 12
    when 0 then concat('#!/usr/bin/env python3', chr(10)) when 1 then concat('#!/bin/bash -e', chr(10))
    when 2 then concat('#!/usr/bin/perl', chr(10)) when 3 then concat('#! /usr/bin/ruby', chr(10))
    when 4 then concat('#!/usr/bin/env node', chr(10)) when 5 then concat(chr(10), ' <?php ')
    when 6 then '<?xml version="1.0"?>' when 7 then ' <!DOCTYPE HTML>' when 8 then concat('# python', chr(10))
    when 9 then concat('#!/usr/bin/fishy', chr(10)) when 10 then 'x <?php ' else '' end, text) as content
from @documents
"""

# Files with names of many kinds, and a rule from the text of every document.
NAMED_FILES = """
select doc_id, concat('host', cast(doc_id % 3 as string)) as host, concat('repo', cast(doc_id % 17 as string)) as repo, 'src' as dir,
  concat(substr(md5(coalesce(text, '')), 1, 12), case when doc_id % 2 = 0 then '.py' else '_test.java' end) as name
from @documents
"""

NAME_RULES = """
select distinct concat('runner', cast(doc_id % 5 as string)) as runner,
  concat(case when doc_id % 3 = 0 then '.*' else '[a-f][a-z0-9]*' end, substr(md5(cast(doc_id as string)), 1, 3), '.*',
    case when doc_id % 4 = 0 then '(_test)?' else '' end, '[.](py|java)') as pattern
from @documents
"""

ENRICHMENT = """
  case row_id % 5 when 0 then 'failed' when 1 then null else 'successful' end as clone_status,
  cast(case when row_id % 5 in (0, 1) or row_id % 13 = 0 then -1 when row_id % 13 = 1 then 0 else (row_id * 37) % 1500 end as bigint) as testfilecountlocal,
  case when row_id % 6 <> 0 then md5(cast(row_id as string)) end as last_commit_hash,
  cast(row_id % 4 as bigint) as JUnit_file_patterns, cast(row_id % 3 as bigint) as pytest_file_patterns, cast(0 as bigint) as Mocha_file_patterns
"""

# The text of a document as comments, and one test function per line break in it.
SOURCES = """
select doc_id, concat('src/', cast(doc_id as string), case when doc_id % 11 = 5 then '.txt' else '.py' end) as file_path,
  concat('# ', replace(body, chr(10), concat(chr(10), '# ')), chr(10),
    case when doc_id % 13 = 0 then 'def broken(:'
    else concat('class T:', chr(10), '    def setUp(self):', chr(10), '        pass', chr(10),
      repeat(concat('    async def fetch(self):', chr(10), '        for a in self:', chr(10), '            for b in a:', chr(10),
        '                try:', chr(10), '                    pass', chr(10), '                except OSError:', chr(10),
        '                    pass', chr(10)), cast(length(body) % 2 as int)),
      repeat(concat('    def test_x(self):', chr(10), '        if self:', chr(10), '            pass', chr(10), '        assert self', chr(10)),
        cast(length(body) - length(replace(body, chr(10), '')) as int))) end) as content
from (select doc_id, coalesce(text, '') as body from @documents)
"""

SEARCH_RESPONSES = """
select user_id as repo, event_id as page,
  case when event_id % 40 = 0 then '{"message":"rate limit"}'
       else concat('{"items":[{"name":"', event_type, '","path":"test/', event_type, '"}]}') end as body
from @events
"""

COMMIT_RESPONSES = """
select event_id as repo,
  case when event_id % 40 = 0 then '[{"message":"gone"}]'
       else concat('[{"sha":"', md5(cast(event_id as string)), '","html_url":"https://github.com/o/r/commit/', cast(event_id as string), '"},{"sha":"0","html_url":"x"}]') end as body
from @events
"""

# Responses for the repositories of the registry, and for some that it does not have.
REPO_SEARCHES = """
select concat('owner', cast(event_id % 5 as string), '/repo', cast(event_id % 4 as string), '.git') as repo,
  case when event_id % 5 = 1 and event_id % 3 = 0 then '{"message":"rate limit"}' else '{"items":[{"name":"a"},{"name":"b"}]}' end as body
from @events
"""

REPO_COMMITS = """
select concat('owner', cast(event_id % 5 as string), '/repo', cast(event_id % 3 as string), '.git') as repo,
  case when event_id % 5 = 2 then '[]' else concat('[{"sha":"', md5(cast(event_id as string)), '","html_url":"u"}]') end as body
from @events
"""

LANGUAGE_RESPONSES = """
select event_id as repo,
  case when event_id % 50 = 0 then 502 else 200 end as status,
  case when event_id % 50 = 0 then 'Bad Gateway'
       else concat('{"data":{"repository":{"languages":{"edges":[{"node":{"name":"', event_type, '"},"size":', cast(user_id as string), '},{"node":{"name":"C"},"size":1}]}}}}') end as body
from @events
"""

OBSERVATIONS = """
select md5(cast(o_custkey as string)) as CommitHash, o_orderstatus as MethodUsed, cast(o_custkey % 97 as bigint) as TestFileCount
from @orders
"""

# Documents that occur in "labels" count as already processed.
LABELLED_PATHS = """
select distinct concat('src/', cast(doc_id as string), '.py') as file_path from @labels
"""


# Repository keys with a checked-out tree and their number of files.
TREE_REPOS = """
select case doc_id % 2 when 0 then concat('gitlab_com/', cast(doc_id as string))
  else concat('github_com/repo', cast(doc_id % 3 as string)) end as repo_key, count(*) as testfilecountlocal
from @documents group by 1
"""

# Repositories whose clone failed; some of them have a tree all the same.
FAILED_REPOS = """
select case doc_id % 2 when 0 then concat('github_com/repo', cast(doc_id % 5 as string))
  else concat('gitlab_com/', cast(doc_id as string)) end as repo_key,
  concat('exit ', cast(doc_id % 7 as string)) as error_message
from @documents
"""


def for_oracle(text: str) -> str:
    return re.sub(r"@(\w+)", r"\1", text)


def derive(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run one of the definitions over the parquet tables of ``sf_dir``."""
    return spark.sql(re.sub(r"@(\w+)", rf"parquet.`{sf_dir}/\1.parquet`", text))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, REGISTRY)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, FILES)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, SOURCES)
