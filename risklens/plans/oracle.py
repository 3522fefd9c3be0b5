"""The registered queries as plain SQL over the same tables, for cross-checks.

Written apart from the operators, in another dialect: windows and recursive
queries where those use chunked ranks and rounds, line tables where those use
arrays and patterns.
"""

from __future__ import annotations

_LINE_ORDER = (
    "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"
)
_TYPE = "CASE {k} % 4 WHEN 0 THEN 'SQL Injection' WHEN 1 THEN 'Path Traversal' WHEN 2 THEN 'Hardcoded Credentials' ELSE 'Weak Hashing' END"

CTES: dict[str, str] = {}

CTES["n"] = "SELECT count(*) AS n FROM part"
CTES["k"] = (
    "SELECT p_partkey AS k, p_name, (p_partkey*7+3)%n AS a, (p_partkey*13+5)%n AS b, (p_partkey+70)%n AS c "
    "FROM part CROSS JOIN n"
)
CTES["files"] = """SELECT 'main' AS project_name,
 concat(CASE WHEN k%11=0 THEN 'build/' ELSE '' END,'pkg',k%10,'/sub',k%7,'/mod_',k,'.py') AS file_path,
 concat('import os',chr(10),'import pkg',a%10,'.sub',a%7,'.mod_',a,chr(10),
  'from pkg',b%10,'.sub',b%7,' import mod_',b,chr(10),'from .mod_',c,' import fn',chr(10),chr(10),
  'def fn_',k,'(x):',chr(10),'    \"""',p_name,'\"""',chr(10),'    def inner(y):',chr(10),'        return y',chr(10),
  CASE WHEN k%5=0 THEN concat('    h = hashlib.md5(x)',chr(10)) ELSE '' END,
  CASE WHEN k%7=0 THEN concat('    token = "t',k,'"',chr(10)) ELSE '' END,
  '    return x',chr(10),chr(10),'class C_',k,':',chr(10),'    def m(self):',chr(10),'        return 1',chr(10)) AS content
 FROM k"""
CTES["graph"] = f"""SELECT * FROM (SELECT l_partkey AS src, lead(l_partkey) OVER w AS dst, l_orderkey AS ord,
 row_number() OVER w AS pos FROM lineitem
 WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER})) t WHERE dst IS NOT NULL"""
CTES["findings"] = f"""SELECT concat('proj',l_suppkey%20) AS project_name,
 row_number() OVER (PARTITION BY l_suppkey%20 ORDER BY {_LINE_ORDER}) AS seq,
 concat('pkg',l_partkey%10,'/mod_',l_partkey,'.py') AS file, concat('fn_',l_linenumber) AS function,
 l_linenumber*10 AS start_line, l_linenumber*10+5 AS end_line, CAST(floor(l_quantity) AS INT)%11 AS risk_score,
 l_returnflag<>'N' AS vulnerable, {_TYPE.format(k='l_partkey')} AS type, l_linestatus='F' AS verified,
 CASE WHEN l_tax>0.04 THEN 'evidence' ELSE '' END AS evidence, (l_orderkey%150)*100+l_linenumber AS finding_id
 FROM lineitem"""
CTES["verdict_raw"] = """SELECT event_id, CASE event_id%8
 WHEN 0 THEN concat('```json',chr(10),'{"vulnerable": true, "risk_score": ',CAST(floor(value) AS INT)%14,', "type": "',event_type,'", "description": "d"}',chr(10),'```')
 WHEN 1 THEN concat('{"vulnerable": false, "risk_score": 0, "type": "none", "description": "',event_type,'"}')
 WHEN 2 THEN concat('Result: {"vulnerable": true, "risk_score": 9, "type": "',event_type,'"} end')
 WHEN 3 THEN props WHEN 4 THEN 'no json here'
 WHEN 5 THEN '{"vulnerable": "false", "risk_score": "8", "type": "t", "description": "d"}'
 WHEN 6 THEN '{"vulnerable": true, "risk_score": 7.9, "type": "t", "description": "d"}'
 ELSE '{"vulnerable": true, "risk_score": "high", "type": "t", "description": "d"}' END AS reply FROM events"""
CTES["attempts"] = """SELECT user_id*100+day(ts) AS finding_id, event_id,
 row_number() OVER (PARTITION BY user_id*100+day(ts) ORDER BY ts,event_id) AS attempt, concat('s',event_id%5) AS strategy,
 CASE event_type WHEN 'purchase' THEN 'EXPLOIT_SUCCESS' WHEN 'view' THEN 'EXPLOIT_FAILED' WHEN 'click' THEN 'done' ELSE '' END AS stdout,
 CASE WHEN event_type='error' THEN 'Traceback' ELSE '' END AS stderr,
 CASE WHEN event_type='error' THEN 1 ELSE 0 END AS exit_code FROM events"""
CTES["issues"] = f"""SELECT o_orderkey AS number,
 concat('[Security] ',{_TYPE.format(k='o_orderkey')},' in fn_',o_orderkey%9,'()') AS title,
 concat('https://example.org/i/',o_orderkey) AS url, CASE WHEN o_orderstatus='F' THEN 'closed' ELSE 'open' END AS state,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'security,tool,critical' WHEN '2-HIGH' THEN 'security,tool' ELSE 'other' END AS labels_csv,
 o_orderkey%10=0 AS is_pr FROM orders"""
CTES["docs"] = (
    "SELECT source AS project_name, concat(lang,'/',doc_id,'.txt') AS file_path, text AS content FROM documents"
)
CTES["progress"] = """SELECT user_id AS session, event_id AS seq, event_id%40=39 AS last,
 CASE WHEN event_id%40<>39 THEN CASE event_type WHEN 'signup' THEN 'init' WHEN 'view' THEN 'red_team'
  WHEN 'click' THEN 'blue_team' WHEN 'purchase' THEN 'pr' ELSE 'error' END END AS phase,
 CASE WHEN event_id%40<>39 THEN concat('step ',event_id) END AS message,
 CASE WHEN event_id%40<>39 THEN CASE event_id%7 WHEN 0 THEN 'recon' WHEN 1 THEN 'plan' WHEN 2 THEN 'success'
  WHEN 3 THEN 'verify' WHEN 4 THEN 'warning' WHEN 5 THEN 'error' ELSE 'other' END END AS type,
 CASE WHEN event_id%40=39 THEN event_id%3<>0 END AS success,
 CASE WHEN event_id%40=39 AND event_id%3<>0 THEN concat('https://example.org/pr/',event_id) END AS pr_url,
 CASE WHEN event_id%40=39 AND event_id%3=0 THEN 'Not verified' END AS error FROM events"""
CTES["lane"] = """SELECT *, CASE WHEN phase IN ('red_team','init') THEN 'A' WHEN phase IN ('blue_team','pr') THEN 'B'
 WHEN phase='error' THEN 'error' END AS lane FROM progress"""
CTES["urls"] = """SELECT page_id, s.shape AS shape, s.url AS url FROM (SELECT page_id, unnest([
 {'shape':'page','url':url}, {'shape':'https','url':concat('https://github.com/owner',page_id%7,'/repo-',page_id)},
 {'shape':'git','url':concat('https://github.com/owner',page_id%7,'/repo-',page_id,'.git')},
 {'shape':'ssh','url':concat('git@github.com:owner',page_id%7,'/repo-',page_id,'.git')},
 {'shape':'short','url':concat('owner',page_id%7,'/repo-',page_id)},
 {'shape':'edit','url':concat('https://github.com/owner',page_id%7,'/repo-',page_id,'/edit')},
 {'shape':'bare','url':concat('repo-',page_id)}]) AS s FROM pages)"""
CTES["slugs"] = r"""SELECT page_id, shape, url, coalesce(
 trim(nullif(regexp_extract(url,'github\.com[:/]([^/]+/[^/\s]+?)(?:\.git)?$',1),''),'/'),
 trim(nullif(regexp_extract(url,'^([^/]+/[^/\s]+)$',1),''),'/'), url) AS slug FROM urls"""

# line tables of the corpus
CTES["lines"] = """SELECT file_path, n AS line, t AS text, length(regexp_extract(t,'^([ \\t]*)',1)) AS indent, trim(t)='' AS blank
 FROM (SELECT file_path, unnest(range(1, len(l)+1)) AS n, unnest(l) AS t
  FROM (SELECT file_path, string_split(content, chr(10)) AS l FROM files))"""
CTES["heads"] = r"""SELECT file_path, line, indent, text,
 CASE WHEN regexp_matches(text,'^\s*class ') THEN 'class' ELSE 'function' END AS node_type,
 regexp_extract(text,'^\s*(?:async def|def|class) +(\w+)',1) AS name
 FROM lines WHERE regexp_matches(text,'^\s*(async def|def|class) +\w+')"""
CTES["closed"] = """SELECT h.file_path, h.line, h.name, h.node_type, min(l.line) AS nxt FROM heads h
 LEFT JOIN lines l ON l.file_path=h.file_path AND l.line>h.line AND NOT l.blank AND l.indent<=h.indent
 GROUP BY ALL"""
CTES["ends"] = """SELECT c.file_path, c.line AS start_line, c.name, c.node_type, max(l.line) AS end_line FROM closed c
 JOIN lines l ON l.file_path=c.file_path AND NOT l.blank AND l.line>=c.line AND (c.nxt IS NULL OR l.line<c.nxt)
 GROUP BY ALL"""
CTES["units"] = r"""SELECT e.file_path, e.name, e.node_type, e.start_line, e.end_line,
 row_number() OVER (PARTITION BY e.file_path ORDER BY e.start_line)-1 AS pos, e.code FROM (
 SELECT e.file_path, e.name, e.node_type, e.start_line, e.end_line,
  ltrim(string_agg(l.text, chr(10) ORDER BY l.line)) AS code
 FROM ends e JOIN lines l ON l.file_path=e.file_path AND l.line BETWEEN e.start_line AND e.end_line
 GROUP BY ALL) e"""
CTES["functions"] = "SELECT * FROM units WHERE node_type='function'"
CTES["rules"] = r"""SELECT * FROM (VALUES
 (0,'hardcoded_credentials','Hardcoded Credentials',8,'(password|api_key|secret|token)\s*=\s*["''][^"'']+["'']','.'),
 (1,'insecure_random','Insecure Randomness',5,'import random','random\.'),
 (2,'weak_hash','Weak Hashing',6,'(?i)(md5|sha1)','.'),
 (3,'sql_fstring','SQL Injection',9,'(?i)f["''](select|insert|update|delete)\s[^"''\n]*\{','.'),
 (4,'shell_fstring','Command Injection',9,'os\.system\(f','.'),
 (5,'unsafe_pickle','Insecure Deserialization',8,'pickle\.loads','.'),
 (6,'path_concat','Path Traversal',7,'open\(\s*["''][^"''\n]*["'']\s*\+','.'),
 (7,'debug_print','Debug Logging',3,'print\(f["'']DEBUG','.')) AS r(ord,rule,type,risk_score,p1,p2)"""
CTES["unit_hits"] = """SELECT f.file_path AS file, f.name AS function, f.pos, f.start_line, f.end_line, f.code, r.ord, r.rule, r.type, r.risk_score
 FROM functions f JOIN rules r ON regexp_matches(f.code, r.p1) AND regexp_matches(f.code, r.p2)"""

# import graph of the corpus
CTES["stmts"] = r"""SELECT file_path, line AS stmt_seq, text AS code,
 CASE WHEN text LIKE 'import %' THEN 'import_statement' ELSE 'import_from_statement' END AS type
 FROM lines WHERE regexp_matches(text,'^(import|from) ')"""
CTES["names"] = r"""SELECT file_path, stmt_seq, 0 AS pos, CASE WHEN type='import_statement'
  THEN regexp_extract(code,'^import ([\w.]+)',1) ELSE regexp_extract(code,'^from ([\w.]+) import',1) END AS module FROM stmts
 UNION ALL SELECT file_path, stmt_seq, 1, concat(regexp_extract(code,'^from ([\w.]+) import',1),'.',
  regexp_extract(code,'import (\w+)$',1)) FROM stmts WHERE type='import_from_statement'"""
CTES["asked"] = "SELECT * FROM names WHERE split_part(module,'.',1) NOT IN ('os','sys','json','re','random')"
CTES["abs_hits"] = """SELECT n.file_path, n.stmt_seq, n.pos, coalesce(a.file_path,b.file_path) AS dst FROM asked n
 LEFT JOIN files a ON a.file_path=concat(replace(module,'.','/'),'.py')
 LEFT JOIN files b ON b.file_path=concat(replace(module,'.','/'),'/__init__.py')
 WHERE module NOT LIKE '.%' AND coalesce(a.file_path,b.file_path) IS NOT NULL"""
CTES["rel_hits"] = r"""SELECT n.file_path, n.stmt_seq, n.pos, coalesce(a.file_path,b.file_path) AS dst FROM (
 SELECT *, regexp_extract(file_path,'^(.*)/[^/]*$',1) AS dir, substr(module,2) AS m FROM asked WHERE module LIKE '.%') n
 LEFT JOIN files a ON a.file_path=concat(dir,'/',m,'.py')
 LEFT JOIN files b ON b.file_path=concat(dir,'/',replace(m,'.','/'),'.py')
 WHERE coalesce(a.file_path,b.file_path) IS NOT NULL"""
CTES["edges"] = """SELECT file_path AS src, dst, stmt_seq, min(pos) AS pos FROM (
 SELECT * FROM abs_hits UNION ALL SELECT * FROM rel_hits) GROUP BY file_path, dst, stmt_seq"""
CTES["bundles"] = """SELECT f.file_path AS root, concat(coalesce(d.t,''),'=== Target: ',f.file_path,' ===',chr(10),f.content) AS bundle
 FROM files f LEFT JOIN (SELECT e.src, string_agg(concat('=== Context: ',e.dst,' ===',chr(10),g.content,chr(10),chr(10)),'' ORDER BY e.k) AS t
  FROM (SELECT src, dst, min(stmt_seq*1000+pos) AS k FROM edges WHERE src<>dst GROUP BY src,dst) e
  JOIN files g ON g.file_path=e.dst GROUP BY e.src) d ON d.src=f.file_path"""

# scoring
CTES["scored0"] = """SELECT *, CASE WHEN verified AND evidence<>'' THEN 10 WHEN verified THEN least(10,risk_score+2)
 WHEN risk_score>=8 THEN risk_score WHEN risk_score>=5 THEN greatest(1,risk_score-1) ELSE 0 END AS final_score,
 CASE WHEN verified AND evidence<>'' THEN 'CRITICAL - VERIFIED WITH EXPLOIT' WHEN verified THEN 'CRITICAL - VERIFIED'
 WHEN risk_score>=8 THEN 'High - Unverified' WHEN risk_score>=5 THEN 'Medium - Unverified' ELSE 'False Positive - Low Risk' END AS label,
 CASE WHEN verified AND evidence<>'' THEN 'Fix immediately - working exploit exists' WHEN verified THEN 'Fix immediately'
 WHEN risk_score>=8 THEN 'Manual review recommended - likely vulnerable' WHEN risk_score>=5 THEN 'Review when resources available'
 ELSE 'Skip - likely false positive' END AS action_recommended FROM findings"""
CTES["scored"] = """SELECT *, CASE WHEN final_score>=8 THEN 'CRITICAL' WHEN final_score>=7 THEN 'HIGH'
 WHEN final_score>=5 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM scored0"""

# verdicts
CTES["plain"] = r"""SELECT event_id, reply, trim(regexp_replace(regexp_replace(regexp_replace(
 trim(reply,chr(10)||' '),'^```json\s*',''),'^```\s*',''),'\s*```$',''),chr(10)||' ') AS t FROM verdict_raw"""
CTES["parsed0"] = r"""SELECT event_id, t, CASE WHEN json_valid(t) THEN t END AS whole,
 regexp_extract(t,'(?s)\{[^}]+\}',0) AS grp FROM plain"""
CTES["parsed1"] = """SELECT *, coalesce(whole, CASE WHEN json_valid(grp) THEN grp END) AS j, whole IS NULL AND grp='' AS missing FROM parsed0"""
CTES["parsed2"] = r"""SELECT *, CASE WHEN j IS NOT NULL AND json_type(j)='OBJECT' THEN j END AS o FROM parsed1"""
CTES["parsed3"] = r"""SELECT *, json_type(o,'$.risk_score') AS rt, json_extract_string(o,'$.risk_score') AS rs,
 json_type(o,'$.vulnerable') AS vt, json_extract_string(o,'$.vulnerable') AS vs,
 json_extract_string(o,'$.type') AS ty, json_extract_string(o,'$.description') AS de FROM parsed2"""
CTES["parsed4"] = r"""SELECT *, CASE WHEN rt IS NULL THEN 0
 WHEN rt='VARCHAR' THEN CASE WHEN regexp_matches(rs,'^\s*[+-]?\d+\s*$') THEN greatest(0,least(10,CAST(trim(rs) AS BIGINT))) END
 WHEN rt='BOOLEAN' THEN CASE WHEN rs='true' THEN 1 ELSE 0 END WHEN rt IN ('NULL','ARRAY','OBJECT') THEN NULL
 ELSE CAST(floor(greatest(0.0,least(10.0,CAST(rs AS DOUBLE)))) AS BIGINT) END AS sc,
 CASE WHEN vt IS NULL OR vt='NULL' THEN false WHEN vt='VARCHAR' THEN vs<>'' WHEN vt='BOOLEAN' THEN vs='true'
 ELSE CAST(vs AS DOUBLE)<>0 END AS vu FROM parsed3"""
CTES["verdicts"] = """SELECT event_id, error, CASE WHEN missing THEN false WHEN error IS NULL THEN vu END AS vulnerable,
 CASE WHEN missing THEN 0 WHEN error IS NULL THEN sc END AS risk_score,
 CASE WHEN missing THEN 'error' WHEN error IS NULL THEN coalesce(ty,'unknown') END AS type,
 CASE WHEN missing THEN 'Failed to parse LLM response' WHEN error IS NULL THEN coalesce(de,'unknown') END AS description
 FROM (SELECT *, CASE WHEN missing THEN NULL WHEN j IS NULL THEN 'invalid JSON' WHEN o IS NULL THEN 'reply is not an object'
  WHEN sc IS NULL THEN 'risk_score is not a number' END AS error FROM parsed4)"""

# attempts
CTES["reasons"] = r"""SELECT *, CASE WHEN contains(lower(stdout),'exploit_success') THEN 'success_marker'
 WHEN contains(lower(stdout),'exploit_failed') THEN 'failure_marker' WHEN exit_code<>0 THEN 'nonzero_exit'
 WHEN regexp_matches(lower(stdout),'uid=|root:|etc/passwd|<script>|<!entity') THEN 'indicator'
 WHEN trim(stdout,' '||chr(9)||chr(10)||chr(13))<>'' THEN 'clean_output' ELSE 'no_evidence' END AS reason FROM {source}"""
CTES["outcomes"] = "SELECT *, reason IN ('success_marker','indicator','clean_output') AS ok FROM (" + CTES["reasons"].format(source="attempts") + ")"
CTES["checks"] = """SELECT finding_id, bool_or(ok) AS verified, coalesce(min(CASE WHEN ok THEN attempt END),3) AS attempts,
 coalesce(arg_min(stdout, attempt) FILTER (ok), arg_max(stdout, attempt)) AS output,
 CASE WHEN bool_or(ok) THEN '' ELSE 'All attempts failed' END AS error
 FROM outcomes WHERE attempt<=3 GROUP BY finding_id"""
CTES["made"] = """SELECT * FROM (SELECT *, min(CASE WHEN ok THEN attempt END) OVER (PARTITION BY finding_id) AS fst
 FROM outcomes WHERE attempt<=3) WHERE fst IS NULL OR attempt<=fst"""
CTES["fixlog"] = "SELECT * REPLACE (attempt-1 AS attempt) FROM outcomes WHERE attempt<=4"
CTES["fixes0"] = """SELECT finding_id, coalesce(bool_or(ok) FILTER (attempt=0), false) AS baseline_ok,
 min(attempt) FILTER (attempt>=1 AND NOT ok) AS fix_at, arg_min(stdout,attempt) FILTER (attempt>=1 AND NOT ok) AS o,
 arg_min(exit_code,attempt) FILTER (attempt>=1 AND NOT ok) AS code, max(stdout) FILTER (attempt=0) AS base
 FROM fixlog GROUP BY finding_id"""
CTES["fixes"] = """SELECT finding_id, baseline_ok, baseline_ok AND fix_at IS NOT NULL AS fixed,
 CASE WHEN NOT baseline_ok THEN 0 ELSE coalesce(fix_at,3) END AS attempts,
 CASE WHEN NOT baseline_ok THEN base WHEN fix_at IS NOT NULL THEN o ELSE '' END AS verification_output,
 baseline_ok AND fix_at IS NOT NULL AND coalesce(code,0)<>0 AS crashed,
 CASE WHEN NOT baseline_ok THEN 'Exploit doesn''t work on original code (false positive)' WHEN fix_at IS NOT NULL THEN ''
 ELSE 'Could not generate valid patch after 3 attempts' END AS error FROM fixes0"""
CTES["versions"] = """SELECT project_name, file_path, content, '2024-01-01' AS analyzed FROM files UNION ALL
 SELECT project_name, file_path, replace(content,'md5','sha256'), '2024-01-02' FROM files WHERE contains(content,'md5')"""
CTES["json_values"] = """SELECT event_id, CASE event_id%12 WHEN 0 THEN '8' WHEN 1 THEN '" 8 "' WHEN 2 THEN '"high"' WHEN 3 THEN 'true'
 WHEN 4 THEN 'false' WHEN 5 THEN 'null' WHEN 6 THEN '[1]' WHEN 7 THEN '"false"' WHEN 8 THEN '""' WHEN 9 THEN '-3'
 WHEN 10 THEN '"-7"' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS raw FROM events"""
CTES["done"] = "SELECT project_name, seq FROM findings WHERE verified AND risk_score>=6"


def _needed(text: str, have: set[str]) -> list[str]:
    """Names of the shared queries a text uses, each after those it uses itself."""
    import re

    out: list[str] = []
    for word in re.findall(r"[a-z_0-9]+", text):
        if word in CTES and word not in have and word not in out and re.search(rf"(?:FROM|JOIN)\s+\(?\s*{word}\b", text):
            for inner in [*_needed(CTES[word], have | set(out)), word]:
                if inner not in out:
                    out.append(inner)
    return out


def _sql(body: str) -> str:
    parts = [f"{name} AS ({CTES[name]})" for name in _needed(body, set())]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


_F = "project_name, file, function, start_line, risk_score, type"
_BODY: dict[str, str] = {}


def _ladder(name: str, *bands: tuple[int, str], rest: str | None) -> str:
    tests = " ".join(f"WHEN risk_score>={n} THEN '{t}'" for n, t in bands)
    return f"CASE {tests} ELSE {'NULL' if rest is None else repr(rest)} END AS {name}"


_BODY.update({
    "src_corpus": """SELECT regexp_extract(file_path,'(pkg\\d+)/',1) AS folder, indent, count(*) FILTER (NOT blank) AS lines,
        sum(length(text)) AS chars FROM lines GROUP BY 1, 2""",
    "src_decode": """SELECT project_name, 'ignore' AS mode, count(*) AS files, sum(length(content)) AS chars FROM docs GROUP BY 1
        UNION ALL SELECT project_name, 'skip', count(*), sum(length(content)) FROM docs WHERE octet_length(encode(content))%3<>0 GROUP BY 1""",
    "sink_upsert": """SELECT sha256(concat(project_name,':',file_path)) AS doc_id, file_path, md5(arg_max(content,analyzed)) AS content_md5,
        max(analyzed) AS analyzed FROM versions GROUP BY project_name, file_path""",
    "sink_quarantine": """SELECT CASE WHEN error IS NULL THEN 'good' ELSE 'bad' END AS kind, count(*) AS n, CAST(NULL AS VARCHAR) AS error FROM verdicts GROUP BY 1
        UNION ALL (SELECT 'error', event_id, error FROM verdicts WHERE error IS NOT NULL ORDER BY event_id LIMIT 5)""",
    "quarantine_split": "SELECT CASE WHEN error IS NULL THEN 'good' ELSE 'bad' END AS side, event_id, error FROM verdicts",
    "documents_round_trip": """SELECT project_name, sha256(concat(project_name,':',file_path)) AS doc_id,
        md5(concat(content,CASE WHEN project_name='src1' THEN '!' ELSE '' END)) AS content_md5 FROM docs""",
    "sink_clear_project": """SELECT project_name, count(*) AS files FROM docs WHERE project_name<>'src0' GROUP BY 1
        UNION ALL SELECT '(deleted)', count(*) FROM docs WHERE project_name='src0'""",
    "src_issues": """SELECT number, title, url, state, labels_csv FROM issues WHERE NOT is_pr AND state='open'
        AND list_contains(string_split(labels_csv,','),'security') AND list_contains(string_split(labels_csv,','),'tool')""",
    "src_session_latest": """SELECT concat('owner_repo',user_id) AS session_id, event_id AS scan_id, event_type AS status FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)=1""",
    "session_drop": "SELECT concat('owner_repo',user_id) AS session_id, count(*) AS scans FROM events WHERE user_id<>3 GROUP BY 1",
    "src_finding_lookup": f"""SELECT 'one' AS lookup, seq, {_F} FROM findings WHERE project_name='proj3' AND seq=17
        UNION ALL SELECT 'all', seq, {_F} FROM findings WHERE project_name='proj3'""",
    "src_doc_lookup": "SELECT file_path, content FROM files WHERE file_path='pkg7/sub3/mod_17.py'",
    "src_stream_ndjson": "SELECT session, count(*) AS records, max(seq) AS last_seq FROM progress GROUP BY session",
    "path_normalize": "SELECT replace(file_path,'/',chr(92)) AS raw, file_path AS path FROM files",
    "path_basename_stem": r"""SELECT file_path, string_split(file_path,'/')[-1] AS basename,
        regexp_replace(string_split(file_path,'/')[-1],'(.)\.[^.]+$','\1') AS stem FROM files""",
    "repo_slug": "SELECT page_id, shape, slug FROM slugs",
    "repo_slug_lenient": r"""SELECT page_id, shape,
        CASE WHEN contains(cut,'github.com') AND len(p)>=2 THEN concat(p[1],'/',p[2]) ELSE cut END AS rstrip,
        CASE WHEN regexp_matches(clean,'^[^/]+/[^/]+') THEN concat(regexp_extract(clean,'^([^/]+)/',1),'/',
          regexp_replace(regexp_extract(clean,'^[^/]+/([^/]+)',1),'\.git','')) END AS ui,
        replace(string_split(url,'github.com/')[-1],'.git','') AS change
        FROM (SELECT *, string_split(string_split(cut,'github.com/')[-1],'/') AS p FROM (SELECT *, rtrim(url,'.git') AS cut,
          regexp_replace(regexp_replace(regexp_replace(url,'https://',''),'http://',''),'github\.com/','') AS clean FROM urls))""",
    "session_key": "SELECT page_id, shape, replace(slug,'/','_') AS session_id FROM slugs",
    "finding_project": """SELECT project_name, seq, start_line AS line, risk_score AS riskScore, file, type AS title,
        CASE WHEN risk_score>=8 THEN 'critical' WHEN risk_score>=6 THEN 'high' WHEN risk_score>=4 THEN 'medium' ELSE 'low' END AS severity,
        '' AS description, function FROM findings""",
    "truncate_fields": "SELECT project_name, file_path, " + ", ".join(
        f"substr(content,1,{n}) AS first_{n}" for n in (150, 200, 300, 500, 1000)) + " FROM docs",
    "filter_path_segments": """SELECT file_path FROM files WHERE NOT list_has_any(string_split(file_path,'/'),
        ['venv','__pycache__','node_modules','dist','build','.tox','.eggs','.mypy_cache','.pytest_cache','site-packages'])
        AND NOT regexp_matches(file_path,'(^|/)\\.')""",
    "filter_path_glob": """SELECT file_path, 'pathlib' AS mode FROM files WHERE NOT regexp_matches(concat('root/',file_path),'(^|/)[^/]*/sub3/[^/]*$')
        AND NOT regexp_matches(concat('root/',file_path),'(^|/)build/[^/]*$')
        UNION ALL SELECT file_path, 'recursive' FROM files WHERE NOT regexp_matches(file_path,'^(.*/)?sub3/.*$') AND file_path NOT LIKE 'build/%'""",
    "filter_path_substring": """SELECT file_path FROM files WHERE NOT contains(file_path,'build') AND NOT contains(file_path,'sub5')
        AND NOT contains(file_path,'__pycache__')""",
    "filter_vulnerable": f"SELECT {_F} FROM findings WHERE vulnerable",
    "filter_min_risk": f"SELECT {_F} FROM findings WHERE vulnerable AND risk_score>=5",
    "filter_actionable": f"SELECT {_F}, final_score FROM scored WHERE final_score>=7 AND verified",
    "filter_strategy": """SELECT project_name, count(*) AS "all", count(*) FILTER (risk_score>=7) AS smart, count(*) FILTER (risk_score>=8) AS critical,
        CAST(0 AS BIGINT) AS none, count(*) FILTER (risk_score>=6) AS demo, count(*) FILTER (risk_score>=7) AS unheard_of FROM findings GROUP BY 1""",
    "filter_alert": """SELECT project_name, CASE WHEN vulnerable AND risk_score>=7 THEN 'high' WHEN vulnerable THEN 'info' END AS alert,
        count(*) AS findings FROM findings GROUP BY 1,2""",
    "gate_critical": """SELECT file, count(*) FILTER (vulnerable AND risk_score>=8) AS blocking,
        count(*) FILTER (vulnerable AND risk_score>=8)=0 AS passed FROM findings GROUP BY 1""",
    "filter_min_length": r"""SELECT event_id, length(CASE WHEN reply LIKE '```%' THEN trim(replace(substr(reply,4),'```',''),chr(10)||' ')
        ELSE trim(reply,chr(10)||' ') END)>=15 AS valid FROM verdict_raw""",
    "filter_required_keys": """SELECT event_id, CASE WHEN whole IS NULL OR json_type(whole)<>'OBJECT' THEN 'Missing required key: vulnerable'
        ELSE (SELECT concat('Missing required key: ', k) FROM (SELECT unnest(['vulnerable','risk_score','type','description']) AS k, unnest([1,2,3,4]) AS i)
          WHERE NOT list_contains(json_keys(whole), k) ORDER BY i LIMIT 1) END AS error FROM parsed0""",
    "lines_explode": "SELECT file_path, line, indent, text, blank FROM lines",
    "units_functions": "SELECT file_path, name, code, start_line, end_line FROM functions",
    "units_docstring": r"""SELECT file_path, name, nullif(regexp_extract(code,'^def[^\n]*\n\s+\"""([^"]*)\"""',1),'') AS docstring FROM functions""",
    "units_classes": "SELECT file_path, name, code, start_line, end_line FROM units WHERE node_type='class'",
    "units_imports_top": "SELECT file_path, stmt_seq AS line, code, type FROM stmts",
    "units_imports_all": """SELECT file_path, stmt_seq AS line, code, type FROM stmts UNION ALL
        SELECT file_path, line, 'import json', 'import_statement' FROM lines WHERE text='    return x'""",
    "symbols_array": "SELECT file_path, string_agg(name, ',' ORDER BY start_line) AS symbols FROM units GROUP BY 1",
    "unit_lookup": """SELECT file, function, rule, md5(code) AS code_md5, length(code) AS n FROM unit_hits
        UNION ALL SELECT file, concat(function,'_gone'), rule, md5(content), length(content) FROM unit_hits JOIN files ON file_path=file""",
    "corpus_unit_stats": """SELECT 'main' AS project_name, (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM functions) AS functions,
        (SELECT count(*) FROM unit_hits) AS vulnerable""",
    "import_names": "SELECT file_path, stmt_seq, pos, module FROM names",
    "import_deny": "SELECT file_path, stmt_seq, pos, module FROM asked",
    "import_resolve_abs": "SELECT file_path, stmt_seq, pos, dst FROM abs_hits",
    "import_resolve_rel": "SELECT file_path, stmt_seq, pos, dst FROM rel_hits",
    "import_edges": "SELECT src, dst, stmt_seq, pos FROM edges WHERE src NOT LIKE 'build/%'",
    "dep_direct": "SELECT CAST(src AS VARCHAR) AS src, ord AS stmt_seq, pos, CAST(dst AS VARCHAR) AS dst FROM graph",
    "dep_reverse": "SELECT DISTINCT CAST(dst AS VARCHAR) AS dst, CAST(src AS VARCHAR) AS src FROM graph",
    "dep_bfs": """, e AS (SELECT DISTINCT src, dst FROM graph),
        r AS (SELECT DISTINCT src AS root, dst, 1 AS level FROM e UNION ALL SELECT DISTINCT a.src, b.dst, 2 FROM e a JOIN e b ON a.dst=b.src)
        SELECT CAST(root AS VARCHAR) AS root, level, count(*) AS files, sum(dst) AS checksum FROM (
         SELECT root, dst, min(level) AS level FROM r WHERE root<>dst GROUP BY root, dst) GROUP BY root, level""",
    "dep_bfs_order": """, e AS (SELECT src, dst, min([stmt_seq,pos]) AS k FROM edges GROUP BY src, dst),
        l1 AS (SELECT src AS root, dst, k FROM e WHERE src<>dst),
        l2 AS (SELECT l1.root, e.dst, min(l1.k || e.k) AS k FROM l1 JOIN e ON l1.dst=e.src WHERE e.dst<>l1.root
          AND NOT EXISTS (SELECT 1 FROM l1 x WHERE x.root=l1.root AND x.dst=e.dst) GROUP BY 1,2),
        l3 AS (SELECT l2.root, e.dst, min(l2.k || e.k) AS k FROM l2 JOIN e ON l2.dst=e.src WHERE e.dst<>l2.root
          AND NOT EXISTS (SELECT 1 FROM l1 x WHERE x.root=l2.root AND x.dst=e.dst)
          AND NOT EXISTS (SELECT 1 FROM l2 x WHERE x.root=l2.root AND x.dst=e.dst) GROUP BY 1,2)
        SELECT root, dst, level, array_to_string(k,'.') AS visit_order FROM (SELECT *, 1 AS level FROM l1
         UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3)""",
    "context_bundle": "SELECT root, bundle FROM bundles",
    "context_for_findings": "SELECT file, function, rule, md5(bundle) AS context_md5 FROM unit_hits JOIN bundles ON root=file",
    "bundle_unpack": r"""SELECT f.file_path AS root, string_split(f.file_path,'/')[-1] AS name, f.file_path AS path, 'Target' AS kind,
        md5(trim(f.content,chr(10)||' ')) AS content_md5 FROM files f
        UNION ALL SELECT e.src, string_split(e.dst,'/')[-1], e.dst, 'Context', md5(trim(g.content,chr(10)||' '))
        FROM (SELECT DISTINCT src, dst FROM edges WHERE src<>dst) e JOIN files g ON g.file_path=e.dst""",
    "graph_stats": """, e AS (SELECT * FROM edges WHERE src NOT LIKE 'build/%'), f AS (SELECT * FROM files WHERE file_path NOT LIKE 'build/%')
        SELECT 'main' AS project_name, (SELECT count(*) FROM f) AS total_files, (SELECT count(*) FROM e) AS total_imports,
        (SELECT count(*) FROM f) AS analyzed_files, (SELECT count(*) FROM f WHERE file_path NOT IN (SELECT src FROM e) AND file_path NOT IN (SELECT dst FROM e)) AS isolated_files,
        round_even((SELECT count(*) FROM e)/(SELECT count(*) FROM f), 2) AS avg_imports_per_file""",
    "graph_isolated": """SELECT file_path FROM files WHERE file_path NOT IN (SELECT file_path FROM rel_hits) AND file_path NOT IN (SELECT dst FROM rel_hits)""",
    "dep_tree": """, o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY stmt_seq DESC, pos DESC)=1 AS last,
          row_number() OVER (PARTITION BY src, dst ORDER BY stmt_seq, pos)=1 AS fst FROM edges)
        SELECT file_path AS root, '' AS place, 0 AS depth, file_path AS node, file_path AS text FROM files
        UNION ALL SELECT concat(file_path,'.gone'), '', 0, concat(file_path,'.gone'), concat('File not found: ',file_path,'.gone') FROM files
        UNION ALL SELECT src, concat(stmt_seq,'.',pos), 1, dst, concat(CASE WHEN last THEN '└── ' ELSE '├── ' END, dst) FROM o
        UNION ALL SELECT a.src, concat(a.stmt_seq,'.',a.pos,'.',b.stmt_seq,'.',b.pos), 2, b.dst,
          concat(CASE WHEN a.last THEN '    ' ELSE '│   ' END, CASE WHEN b.last THEN '└── ' ELSE '├── ' END, b.dst)
          FROM o a JOIN o b ON b.src=a.dst WHERE a.fst AND a.src<>a.dst""",
    # a walk with its stack as a list: each step lists the first entry and opens it
    "dep_tree_deep": """, c AS (SELECT src, list({'place': [stmt_seq,pos], 'dst': dst, 'last': last} ORDER BY stmt_seq, pos) AS kids FROM (
         SELECT *, row_number() OVER (PARTITION BY src ORDER BY stmt_seq DESC, pos DESC)=1 AS last FROM edges) GROUP BY src),
        w(root, stack, opened) AS (SELECT file_path, [{'path': CAST([] AS BIGINT[]), 'node': file_path, 'depth': 0, 'text': file_path, 'indent': ''}],
          CAST([] AS VARCHAR[]) FROM files
         UNION ALL SELECT root, CASE WHEN opens THEN list_concat(list_transform(kids, lambda k: {'path': list_concat(t.path, k.place), 'node': k.dst,
           'depth': t.depth+1, 'text': concat(t.indent, CASE WHEN k.last THEN '└── ' ELSE '├── ' END, k.dst),
           'indent': concat(t.indent, CASE WHEN k.last THEN '    ' ELSE '│   ' END)}), stack[2:]) ELSE stack[2:] END,
          CASE WHEN opens THEN list_append(opened, t.node) ELSE opened END
          FROM (SELECT root, stack, opened, kids, stack[1] AS t, kids IS NOT NULL AND stack[1].depth<3 AND NOT list_contains(opened, stack[1].node) AS opens
           FROM w LEFT JOIN c ON c.src=stack[1].node WHERE len(stack)>0))
        SELECT root, coalesce(array_to_string(stack[1].path,'.'),'') AS place, stack[1].depth AS depth, stack[1].node AS node, stack[1].text AS text
        FROM w WHERE len(stack)>0""",
    "fence_strip": r"""SELECT event_id, t AS plain, CASE WHEN reply LIKE '```json%' THEN trim(replace(substr(reply,8),'```',''),chr(10)||' ')
        ELSE trim(reply,chr(10)||' ') END AS cut FROM plain""",
    "verdict_parse": "SELECT event_id, vulnerable, risk_score, type, description, error FROM verdicts",
    "verdict_defaults": """SELECT type, description, count(*) AS verdicts, sum(risk_score) AS score_sum, count(*) FILTER (vulnerable) AS vulnerable
        FROM verdicts WHERE error IS NULL GROUP BY 1,2""",
    "verdict_clamp": r"""SELECT event_id, CASE json_type(raw) WHEN 'VARCHAR' THEN CASE WHEN regexp_matches(raw,'^"\s*[+-]?\d+\s*"$')
          THEN greatest(0,least(10,CAST(trim(json_extract_string(raw,'$')) AS BIGINT))) END
        WHEN 'BOOLEAN' THEN CASE WHEN raw='true' THEN 1 ELSE 0 END WHEN 'NULL' THEN NULL WHEN 'ARRAY' THEN NULL
        ELSE CAST(floor(greatest(0.0,least(10.0,CAST(raw AS DOUBLE)))) AS BIGINT) END AS score FROM json_values""",
    "verdict_bool": """SELECT event_id, CASE json_type(raw) WHEN 'VARCHAR' THEN raw<>'""' WHEN 'BOOLEAN' THEN raw='true' WHEN 'NULL' THEN false
        WHEN 'ARRAY' THEN true ELSE CAST(raw AS DOUBLE)<>0 END AS truthy,
        CASE json_type(raw) WHEN 'VARCHAR' THEN raw NOT IN ('""','"false"') WHEN 'BOOLEAN' THEN raw='true' WHEN 'NULL' THEN false
        WHEN 'ARRAY' THEN true ELSE CAST(raw AS DOUBLE)<>0 END AS read FROM json_values""",
    "json_field_regex": r"""SELECT event_id, CASE WHEN t<>'' AND d<>'' THEN t END AS type, CASE WHEN t<>'' AND d<>'' THEN d END AS description FROM (
        SELECT event_id, regexp_extract(reply,'"type"\s*:\s*"([^"]*)"',1) AS t, regexp_extract(reply,'"description"\s*:\s*"([^"]*)"',1) AS d FROM verdict_raw)""",
    "error_findings": """SELECT event_id, coalesce(vulnerable,false) AS vulnerable, coalesce(risk_score,0) AS risk_score,
        CASE WHEN error IS NULL THEN type ELSE 'analysis_error' END AS type,
        CASE WHEN error IS NULL THEN description ELSE concat('Failed to analyze: Vulnerability analysis failed: ',error) END AS description FROM verdicts""",
    "finding_assemble": """SELECT f.file_path AS file, f.name AS function, f.pos, f.start_line, f.end_line, CASE WHEN failed THEN 0 ELSE coalesce(h.risk_score,0) END AS risk_score,
        NOT failed AND h.rule IS NOT NULL AS vulnerable, CASE WHEN failed THEN 'analysis_error' ELSE coalesce(h.type,'None') END AS type,
        CASE WHEN failed THEN 'Failed to analyze: no verdict' WHEN h.rule IS NULL THEN 'No issue found' ELSE concat('pattern rule ',h.rule) END AS description
        FROM (SELECT *, CAST(regexp_extract(file_path,'mod_([0-9]+)[.]py$',1) AS BIGINT)%13=0 AS failed FROM functions) f LEFT JOIN (
         SELECT file, pos, max(risk_score) AS risk_score, arg_max(type,risk_score) AS type, arg_max(rule,risk_score) AS rule FROM unit_hits GROUP BY 1,2) h
        ON h.file=f.file_path AND h.pos=f.pos""",
    "rule_scan": """SELECT project_name, file_path, rule, type, risk_score FROM docs JOIN rules ON regexp_matches(content,p1) AND regexp_matches(content,p2)""",
    "rule_scan_units": "SELECT file, function, rule, risk_score, start_line FROM unit_hits",
    "rule_places": r"""SELECT file_path, rule, nth, 1+length(ahead)-length(replace(ahead,chr(10),'')) AS line,
        1+length(string_split(ahead,chr(10))[-1]) AS "column", found[nth] AS match FROM (
        SELECT *, array_to_string(list_transform(range(1, nth+1), lambda i: concat(parts[i], CASE WHEN i<nth THEN found[i] ELSE '' END)),'') AS ahead FROM (
         SELECT file_path, rule, parts, found, unnest(range(1, len(found)+1)) AS nth FROM (
          SELECT file_path, rule, string_split_regex(content,p1) AS parts, regexp_extract_all(content,p1) AS found FROM files
          JOIN rules ON regexp_matches(content,p1) AND regexp_matches(content,p2))))""",
    "rule_summary": """SELECT rule, type, count(*) AS hits, count(DISTINCT project_name) AS projects FROM (
        SELECT project_name, content FROM docs UNION ALL SELECT project_name, content FROM files) x
        JOIN rules ON regexp_matches(content,p1) AND regexp_matches(content,p2) GROUP BY 1,2""",
    "tier_fallback": """SELECT event_id, CASE WHEN ok1 THEN 1 WHEN ok2 THEN 2 WHEN ok3 THEN 3 END AS tier,
        CASE WHEN ok1 THEN concat('one ',event_type) WHEN ok2 THEN concat('two ',event_type) WHEN ok3 THEN concat('three ',event_type) END AS reply,
        CASE WHEN ok1 THEN 0 WHEN ok2 THEN 1 WHEN ok3 THEN 2 ELSE 3 END AS switches,
        CASE WHEN NOT ok1 AND NOT ok2 AND NOT ok3 THEN concat('All tiers failed. Tier 1 (primary): 429 for ',event_type,
        '. Tier 2 (fallback): Connection reset. Tier 3 (last): No such model.') END AS error
        FROM (SELECT *, event_type NOT IN ('error','view') AS ok1, (event_id+user_id)%4<>0 AS ok2, event_id%3<>0 AS ok3 FROM events)""",
    "error_classify": """SELECT event_id, CASE event_id%8 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'rate_limit' WHEN 3 THEN 'timeout'
        WHEN 4 THEN 'connection' WHEN 5 THEN 'non_retryable' WHEN 6 THEN 'non_retryable' ELSE 'timeout' END AS error_class,
        event_id%8 IN (0,1,2,3,5,7) AS retryable FROM events""",
    "chat_assemble": """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY role<>'system', turn) AS position, role, md5(text) AS text_md5,
        md5(coalesce(first_value(text) OVER (PARTITION BY conv_id ORDER BY role<>'user', turn),'')) AS prompt_md5 FROM conversations""",
    "prompt_render": """SELECT file_path, name, concat('Analyze this Python function for security vulnerabilities:',chr(10),chr(10),'```python',chr(10),
        code,chr(10),'```',chr(10),chr(10),'Return your analysis as JSON.') AS prompt FROM functions""",
    "risk_final": "SELECT project_name, file, function, risk_score, final_score, label, action_recommended, priority FROM scored",
    "severity_ladders": "SELECT project_name, priority, api, ui, report, label, badge, count(*) AS findings, sum(risk_score) AS score_sum FROM (SELECT project_name, risk_score, "
        + ", ".join([
            _ladder("priority", (8, "CRITICAL"), (7, "HIGH"), (5, "MEDIUM"), rest="LOW"),
            _ladder("api", (8, "critical"), (6, "high"), (4, "medium"), rest="low"),
            _ladder("ui", (8, "CRITICAL"), (7, "HIGH"), (4, "MEDIUM"), rest="LOW"),
            _ladder("report", (8, "critical"), (7, "high"), (5, "medium"), rest="low"),
            _ladder("label", (8, "critical"), (7, "high-priority"), rest=None),
            _ladder("badge", (9, "red"), (7, "orange"), (5, "yellow"), rest="green"),
        ]) + " FROM findings) GROUP BY ALL",
    "score_effective": "SELECT project_name, file, function, CASE WHEN verified THEN final_score ELSE risk_score END AS score FROM scored",
    "rank_findings": """SELECT project_name, seq, final_score, row_number() OVER (PARTITION BY project_name ORDER BY final_score DESC, seq) AS rank
        FROM scored WHERE vulnerable""",
    "rank_overall": """SELECT project_name, seq, final_score, row_number() OVER (ORDER BY final_score DESC, project_name, seq) AS rank
        FROM scored WHERE vulnerable""",
    "number_findings": """SELECT project_name, seq, row_number() OVER (PARTITION BY project_name ORDER BY seq) AS id, file, function
        FROM findings WHERE vulnerable""",
    "verify_budget": """, p AS (SELECT *, risk_score>=7 AND count(*) FILTER (risk_score>=7) OVER (PARTITION BY project_name ORDER BY seq)<=25 AS selected FROM findings),
        s AS (SELECT *, CASE WHEN selected AND verified AND evidence<>'' THEN 10 WHEN selected AND verified THEN least(10,risk_score+2)
          WHEN risk_score>=8 THEN risk_score WHEN risk_score>=5 THEN risk_score-1 ELSE 0 END AS final_score,
          CASE WHEN selected AND verified AND evidence<>'' THEN 'CRITICAL - VERIFIED WITH EXPLOIT' WHEN selected AND verified THEN 'CRITICAL - VERIFIED'
          WHEN risk_score>=8 THEN 'High - Unverified' WHEN risk_score>=5 THEN 'Medium - Unverified' ELSE 'False Positive - Low Risk' END AS label FROM p)
        SELECT project_name, seq, final_score, row_number() OVER (PARTITION BY project_name ORDER BY final_score DESC, seq) AS rank, selected, label FROM s""",
    "verify_merge": """, m AS (SELECT f.* EXCLUDE (verified, evidence), coalesce(c.verified,false) AS verified, coalesce(c.output,'') AS output,
          CASE WHEN c.verified THEN c.output ELSE '' END AS ev, nullif(c.error,'') AS err FROM findings f LEFT JOIN checks c USING (finding_id))
        SELECT project_name, file, function, finding_id, risk_score, CASE WHEN verified AND ev<>'' THEN 10 WHEN verified THEN least(10,risk_score+2)
         WHEN risk_score>=8 THEN risk_score WHEN risk_score>=5 THEN risk_score-1 ELSE 0 END AS final_score, verified, output AS exploit_output,
         err AS verification_error, CASE WHEN verified AND ev<>'' THEN 'CRITICAL - VERIFIED WITH EXPLOIT' WHEN verified THEN 'CRITICAL - VERIFIED'
         WHEN risk_score>=8 THEN 'High - Unverified' WHEN risk_score>=5 THEN 'Medium - Unverified' ELSE 'False Positive - Low Risk' END AS label,
         'Unknown' AS severity_rating FROM m""",
    "summary_api": """SELECT project_name, count(*) FILTER (vulnerable) AS total, count(*) FILTER (vulnerable AND risk_score>=8) AS critical,
        count(*) FILTER (vulnerable AND risk_score IN (6,7)) AS high, count(*) FILTER (vulnerable AND risk_score IN (4,5)) AS medium,
        count(*) FILTER (vulnerable AND risk_score<4) AS low, count(DISTINCT file) AS scanned_files FROM findings GROUP BY 1""",
    "summary_audit": """SELECT project_name, count(*) AS total, count(*) FILTER (verified) AS verified, count(*) FILTER (final_score>=8) AS critical,
        count(*) FILTER (final_score=7) AS high, count(*) FILTER (final_score IN (5,6)) AS medium, count(*) FILTER (final_score=0) AS false_positives
        FROM scored WHERE vulnerable GROUP BY 1""",
    "report_audit": """SELECT project_name, count(*) AS functions, count(*) FILTER (vulnerable) AS vulnerable,
        count(*) FILTER (vulnerable AND risk_score>=8) AS critical, count(*) FILTER (vulnerable AND risk_score=7) AS high,
        count(*) FILTER (vulnerable AND risk_score IN (5,6)) AS medium, count(*) FILTER (vulnerable AND risk_score<5) AS low FROM findings GROUP BY 1""",
    "report_audit_rows": f"""SELECT {_F}, CASE WHEN risk_score>=8 THEN 'critical' ELSE 'high' END AS band FROM findings WHERE vulnerable AND risk_score>=7""",
    "report_priority": """SELECT project_name, count(*) AS total, count(*) FILTER (final_score>=8) AS critical, count(*) FILTER (final_score=7) AS high,
        count(*) FILTER (final_score IN (5,6)) AS medium, count(*) FILTER (final_score<5) AS low, count(*) FILTER (verified) AS verified,
        count(*) FILTER (final_score=0) AS false_positives FROM scored GROUP BY 1""",
    "topk_per_band": """SELECT project_name, priority AS band, idx, seq, final_score, type, function FROM (SELECT *,
        row_number() OVER (PARTITION BY project_name, priority ORDER BY final_score DESC, seq) AS idx FROM scored)
        WHERE (priority='CRITICAL' AND idx<=5) OR (priority='HIGH' AND idx<=3)""",
    "summary_verified": """SELECT project_name, count(*) AS total, count(*) FILTER (verified) AS verified, count(*) FILTER (NOT verified) AS unverified,
        count(*) FILTER (final_score>=8) AS critical FROM scored GROUP BY 1""",
    "review_reduction": """SELECT *, round_even((total-to_review)*100.0/total,2) AS reduction_pct, round_even(false_positives*100.0/total,2) AS false_positive_pct
        FROM (SELECT project_name, count(*) AS total, count(*) FILTER (verified OR risk_score>=8) AS to_review,
        count(*) FILTER (final_score=0) AS false_positives FROM scored GROUP BY 1)""",
    "metric_max_risk": """SELECT concat(project_name,'/',substr(file,1,4)) AS project_name, count(*) FILTER (vulnerable) AS threats,
        count(DISTINCT file)*100 AS scanned, coalesce(CAST(max(risk_score) FILTER (vulnerable) AS DOUBLE), 8.0) AS risk_score
        FROM findings GROUP BY 1""",
    "pick_front": """SELECT project_name, seq, rank, CASE WHEN rank=5 THEN 1 WHEN rank<5 THEN rank+1 ELSE rank END AS position FROM (SELECT *,
        row_number() OVER (PARTITION BY project_name ORDER BY risk_score DESC, seq) AS rank FROM findings WHERE vulnerable)""",
    "queue_order": """SELECT project_name, seq, row_number() OVER w AS position, lead(seq) OVER w AS next_item,
        CASE WHEN row_number() OVER w=1 THEN 'current' ELSE 'queued' END AS state FROM findings WHERE verified
        WINDOW w AS (PARTITION BY project_name ORDER BY risk_score DESC, seq)""",
    "remaining_work": """SELECT project_name, count(*) AS remaining, min(seq) AS first_seq FROM findings ANTI JOIN done USING (project_name, seq) GROUP BY 1""",
    "remediated_links": """SELECT f.project_name, f.seq, f.type, l.url FROM (SELECT * FROM findings WHERE verified AND risk_score>=6) f LEFT JOIN (
        SELECT concat('proj',number%20) AS project_name, number//40 AS seq, arg_max(url,number) AS url FROM issues GROUP BY 1,2) l
        ON l.project_name=f.project_name AND l.seq=f.seq""",
    "action_log_summary": """SELECT user_id AS session, count(*) FILTER (open AND event_type='purchase') AS fixed,
        count(*) FILTER (open AND event_type IN ('view','signup')) AS skipped, count(*) AS total FROM (SELECT *,
        count(*) FILTER (event_type='error') OVER (PARTITION BY user_id ORDER BY event_id)=0 AS open FROM events) GROUP BY 1""",
    "outcome_classify": "SELECT finding_id, event_id, ok FROM outcomes",
    "outcome_reason": "SELECT reason, reason IN ('success_marker','indicator','clean_output') AS ok, count(*) AS runs FROM ("
        + CTES["reasons"].format(source="(SELECT content AS stdout, 0 AS exit_code FROM docs UNION ALL SELECT stdout, exit_code FROM attempts)")
        + ") GROUP BY 1,2",
    "first_success": "SELECT finding_id, verified, attempts, output, error FROM checks",
    "attempt_failures": """SELECT finding_id, attempt, CASE WHEN g THEN 'generation failed' ELSE strategy END AS strategy,
        CASE WHEN NOT g THEN stdout END AS stdout, CASE WHEN NOT g THEN stderr END AS stderr, CASE WHEN NOT g THEN exit_code END AS exit_code,
        CASE WHEN g THEN 'no reply' END AS error, 'FAILED' AS result FROM (SELECT *, stdout='' AND exit_code=0 AS g FROM made WHERE NOT ok)""",
    "attempt_history_digest": """, t AS (SELECT *, concat(chr(10),'Attempt #',attempt,':',chr(10),'Strategy: ',strategy,chr(10),
          CASE WHEN stderr<>'' THEN concat('Error: ',stderr,chr(10)) ELSE '' END,'Result: FAILED',chr(10)) AS e FROM made)
        SELECT finding_id, attempt, concat(lag(e,2,'') OVER w, lag(e,1,'') OVER w) AS digest, row_number() OVER w-1 AS earlier_failures FROM t
        WINDOW w AS (PARTITION BY finding_id ORDER BY attempt)""",
    "baseline_gate": "SELECT finding_id, baseline_ok FROM fixes",
    "fix_verified": "SELECT finding_id, baseline_ok, fixed, attempts, verification_output, crashed, error FROM fixes",
    "attempt_rates": "SELECT finding_id%100 AS day, count(*) AS findings, count(*) FILTER (baseline_ok) AS baseline_ok, " + ", ".join(
        f"round_even(count(*) FILTER (fixed AND attempts<={n})*100.0/nullif(count(*) FILTER (baseline_ok),0),2) AS fixed_by_{n}_pct" for n in (1, 2, 3))
        + ", round_even(count(*) FILTER (NOT baseline_ok)*100.0/count(*),2) AS false_positive_pct FROM fixes GROUP BY 1",
    "verification_status": """SELECT finding_id, CASE WHEN verified THEN 'VERIFIED' ELSE 'NOT VERIFIED' END AS status, attempts, substr(output,1,500) AS output,
        CASE WHEN error<>'' THEN concat('Error: ',error) END AS error, 'check' AS kind FROM checks
        UNION ALL SELECT finding_id, CASE WHEN fixed THEN 'PATCH VERIFIED' ELSE 'PATCH FAILED' END, attempts, substr(verification_output,1,500),
        CASE WHEN error<>'' THEN concat('Error: ',error) END, 'fix' FROM fixes""",
    "issue_title": """SELECT project_name, concat('[Security] ',type,' in ',function,'()') AS title, concat('Security: ',type,' in ',file) AS file_title FROM findings""",
    "issue_dedupe": """, x AS (SELECT replace(replace(title,'Weak Hashing','Other'),'Path Traversal','Other') AS title FROM issues
          WHERE NOT is_pr AND state='open' AND labels_csv LIKE 'security,tool%')
        SELECT project_name, file, function, risk_score, title FROM (SELECT *, concat('[Security] ',type,' in ',function,'()') AS title
         FROM findings WHERE vulnerable AND risk_score>=5) WHERE title NOT IN (SELECT title FROM x)""",
    "issue_dedupe_batch": """, x AS (SELECT replace(replace(title,'Weak Hashing','Other'),'Path Traversal','Other') AS title FROM issues
          WHERE NOT is_pr AND state='open' AND labels_csv LIKE 'security,tool%')
        SELECT title, max(risk_score) AS risk_score FROM (SELECT *, concat('[Security] ',type,' in ',function,'()') AS title
         FROM findings WHERE vulnerable AND risk_score>=5) WHERE title NOT IN (SELECT title FROM x) GROUP BY 1""",
    "issue_labels": """SELECT project_name, file, function, risk_score,
        concat('security',CASE WHEN risk_score>=8 THEN ',critical' WHEN risk_score>=7 THEN ',high-priority' ELSE '' END) AS audit_labels,
        concat('security',CASE priority WHEN 'CRITICAL' THEN ',critical' WHEN 'HIGH' THEN ',high-priority' ELSE '' END,
         CASE WHEN verified THEN ',verified' ELSE '' END) AS verified_labels FROM scored""",
    "issue_body": """, b AS (SELECT *, concat(chr(10),'**Type:** ',type,chr(10),'**File:** `',file,'`',chr(10),'**Function:** `',function,'()`',chr(10),
          '**Lines:** ',start_line,'-',end_line,chr(10),chr(10),'### Description',chr(10),chr(10)) AS place,
          concat(chr(10),chr(10),'---',chr(10),chr(10),'*This issue was created automatically.*',chr(10)) AS foot,
          concat(chr(10),chr(10),'### Recommendation',chr(10),chr(10)) AS rec FROM scored)
        SELECT 'audit' AS template, file, function, concat('## ',CASE WHEN risk_score>=9 THEN '🔴' WHEN risk_score>=7 THEN '🟠' WHEN risk_score>=5 THEN '🟡' ELSE '🟢' END,
         ' Security Vulnerability Detected',chr(10),chr(10),'**Risk Score:** ',risk_score,'/10',place,rec,
         'Please review the affected code and apply appropriate security fixes.',foot) AS body FROM b
        UNION ALL SELECT 'verified', file, function, concat('## 🔴 Security Vulnerability Detected',chr(10),chr(10),'**Status:** ',
         CASE WHEN verified THEN '✅ VERIFIED' ELSE '❌ Unverified' END,chr(10),'**Risk Score:** ',final_score,'/10',chr(10),'**Priority:** ',priority,place,
         'No description available',rec,action_recommended,chr(10),CASE WHEN verified AND evidence<>'' THEN concat(chr(10),chr(10),'### Verification',chr(10),chr(10),
         'This vulnerability has been verified.',chr(10),chr(10),'**Output:**',chr(10),'```',chr(10),'ran ',function,chr(10),'```',chr(10)) ELSE '' END,foot) FROM b""",
    "change_record": """, x AS (SELECT concat('proj',number%20) AS repo, number//40 AS n, arg_min(url, (CASE state WHEN 'open' THEN '0' ELSE '1' END)||url) AS url FROM issues GROUP BY 1,2)
        SELECT project_name AS repo, concat('security/fix-',seq) AS branch, seq AS number, concat('🔒 Security Fix: ',type) AS title,
         concat('fix: ',type,' security vulnerability',chr(10),chr(10),'Fixes #',seq) AS commit_message,
         concat('## Security Patch',chr(10),chr(10),'This PR fixes a **',type,'** vulnerability identified in issue #',seq,'.',chr(10),chr(10),
          '### Changes',chr(10),'- Fixed: `',file,'`',chr(10),chr(10),'Fixes #',seq,chr(10)) AS body, x.url AS existing_url
        FROM findings f LEFT JOIN x ON x.repo=f.project_name AND x.n=f.seq WHERE verified AND evidence<>''""",
    "stream_parse": "SELECT session, seq, phase, message, type, success, pr_url, error FROM progress",
    "stream_route": "SELECT session, seq, lane, message FROM lane WHERE lane IS NOT NULL",
    "stream_type_map": """SELECT session, seq, type, CASE WHEN type IN ('recon','plan','success','verify') THEN type ELSE 'info' END AS shown
        FROM lane WHERE lane IS NOT NULL""",
    "stream_terminal": "SELECT session, seq, success, pr_url IS NOT NULL AS strict, pr_url, error FROM progress WHERE success IS NOT NULL",
    "stream_session_state": """, t AS (SELECT session, min(seq) AS t FROM progress WHERE last GROUP BY 1),
        v AS (SELECT l.*, t.t FROM lane l LEFT JOIN t USING (session) WHERE t.t IS NULL OR l.seq<=t.t)
        SELECT session, count(*) FILTER (lane IN ('A','B')) AS n_lines, arg_max(lane,seq) FILTER (lane IN ('A','B')) AS lane,
         max(seq) FILTER (lane IN ('A','B')) AS lane_seq,
         coalesce(max(error), arg_max(message,seq) FILTER (lane='error')) AS last_error, max(seq) FILTER (lane='error') AS error_seq,
         max(t) IS NOT NULL AS done, bool_or(success) AS success, max(pr_url) AS pr_url FROM v GROUP BY 1""",
    "stream_graph": "SELECT src, dst, stmt_seq, pos FROM edges",
    "stream_documents": """SELECT file_path, md5(content) AS content_md5, symbols, coalesce(imports, '') AS imports FROM files
        JOIN (SELECT file_path, string_agg(name, ',' ORDER BY start_line) AS symbols FROM units GROUP BY 1) USING (file_path)
        LEFT JOIN (SELECT src AS file_path, string_agg(dst, ',' ORDER BY stmt_seq, pos) AS imports FROM edges GROUP BY 1) USING (file_path)""",
    "scan_repository": """SELECT 'main' AS project_name, id, row_number() OVER (ORDER BY risk_score DESC, id) AS rank, file, function, type,
        CASE WHEN risk_score>=8 THEN 'critical' WHEN risk_score>=6 THEN 'high' WHEN risk_score>=4 THEN 'medium' ELSE 'low' END AS severity,
        risk_score, start_line FROM (SELECT *, row_number() OVER (ORDER BY CAST(regexp_extract(file,'mod_(\\d+)\\.py$',1) AS BIGINT), pos, ord) AS id
         FROM unit_hits WHERE file NOT LIKE 'build/%')""",
})
_BODY["stream_upsert"] = _BODY["sink_upsert"]


def _statement(body: str) -> str:
    """A body that starts with a comma brings its own further queries."""
    body = body.strip()
    if not body.startswith(","):
        return _sql(body)
    parts = [f"{name} AS ({CTES[name]})" for name in _needed(body, set())]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


ORACLE: dict[str, str] = {name: _statement(body) for name, body in _BODY.items()}
