"""Derived input tables: they add to the driver's tables what a crawl would bring.  The same SQL runs in Spark and in the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {}

VIEWS["pages_ext"] = """
SELECT page_id, url, regexp_extract(url,'^https?://([^/?#]+)',1) AS host,
 replace(replace(replace(html,'</head>',concat(
   CASE WHEN page_id % 3 = 0 THEN concat('<link rel="canonical" href="', CASE WHEN page_id % 9 = 0 THEN 'https://other.example.org/x' WHEN page_id % 6 = 0 THEN 'www.example.net/y' ELSE url END,'">') ELSE '' END,
   CASE WHEN page_id % 12 = 0 THEN '<link rel="alternate canonical" href="/dup">' ELSE '' END,
   CASE WHEN page_id % 4 <> 0 THEN concat('<meta name="description" content="About topic ', CAST(page_id % 25 AS VARCHAR(10)),' and more text here">') ELSE '' END,
   CASE WHEN page_id % 10 = 0 THEN '<meta name="robots" content="noindex,follow">' ELSE '' END,
   '<link rel="stylesheet" href="/css/', CAST(page_id % 5 AS VARCHAR(10)),'.css"><script src="/js/', CAST(page_id % 8 AS VARCHAR(10)),'.js"></script></head>')),
  '</article>',concat('<img src="/img/', CAST(page_id % 40 AS VARCHAR(10)),'.png" alt="', CASE WHEN page_id % 2 = 0 THEN 'pic' ELSE '' END,'"><img src="/img/logo.svg" alt="">',
   CASE WHEN page_id % 5 = 0 THEN '<a href="http://ext.example.org/p">ext</a>' ELSE '' END,
   CASE WHEN page_id % 14 = 0 THEN '<a href="/o">out<a href="/i">in</a></a>' ELSE '' END,
   '</article>')),
  '<nav>',CASE WHEN page_id % 15 = 0 THEN '<nav><i id="x"></i><i id="x"></i>' ELSE '<nav>' END) AS html
FROM pages
"""

VIEWS["fetches"] = """
SELECT page_id AS seq, host, url AS original_url,
 CASE WHEN page_id % 7 = 0 THEN regexp_replace(url,'^http:','https:') WHEN page_id % 23 = 0 THEN concat('https://www.',host,'/') ELSE url END AS final_url,
 CASE WHEN page_id % 11 = 0 THEN 404 WHEN page_id % 13 = 0 THEN 503 ELSE 200 END AS status_code,
 CASE WHEN page_id % 17 = 0 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type,
 CAST(CASE WHEN page_id % 4 = 0 THEN 2048 ELSE length(html) END AS BIGINT) AS content_length,
 CAST((page_id * 37) % 600 AS DOUBLE) / 100 AS load_seconds,
 CASE WHEN page_id % 19 = 0 THEN 'noindex, nofollow' END AS x_robots_tag, html
FROM pages_ext
"""

VIEWS["robots_files"] = """
SELECT DISTINCT host, 'https' AS scheme, 200 AS status_code, concat('User-agent: *',chr(10),'Disallow: /de/',chr(10),'Allow: /de/1',chr(10),
 CASE WHEN length(host) % 3 = 0 THEN concat('User-agent: MyCrawler',chr(10),'Disallow: /*.html$',chr(10)) ELSE '' END,
 CASE WHEN length(host) % 5 = 0 THEN concat('bad line',chr(10),'Foo: bar',chr(10),'Crawl-delay: x',chr(10)) ELSE '' END,
 'Sitemap: https://',host,'/sitemap.xml',chr(10)) AS body FROM pages_ext
"""

VIEWS["sitemap_entries"] = """
SELECT host, concat('https://',host,'/sitemap.xml') AS sitemap_url, regexp_replace(url,'^http:','https:') AS loc FROM pages_ext WHERE page_id % 2 = 0
 UNION ALL SELECT DISTINCT host, concat('https://',host,'/sitemap.xml'), concat('https://',host,'/only-in-sitemap') FROM pages_ext
"""

VIEWS["probes"] = """
SELECT e.event_id, e.ts, p.host, p.url, CASE e.event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 404 ELSE 200 END AS status_code,
 e.value / 100 AS load_seconds, CAST(floor(e.value * 20) AS BIGINT) + 1000 AS body_size
 FROM (SELECT ev.*, ev.event_id % n.cnt AS pid FROM events ev CROSS JOIN (SELECT count(*) AS cnt FROM pages) n) e JOIN pages_ext p ON p.page_id = e.pid
"""

VIEWS["redirects"] = """
SELECT seq, host, original_url AS from_url, 301 AS status_code, CASE WHEN seq % 2 = 0 THEN concat('https://',host,'/hop/',CAST(seq AS VARCHAR(10))) ELSE final_url END AS location FROM fetches WHERE original_url <> final_url
 UNION ALL SELECT seq, host, concat('https://',host,'/hop/',CAST(seq AS VARCHAR(10))), 302, final_url FROM fetches WHERE original_url <> final_url AND seq % 2 = 0
"""

VIEWS["url_status"] = """
SELECT DISTINCT concat(o,'/css/',CAST(page_id % 5 AS VARCHAR(10)),'.css') AS url, CASE WHEN page_id % 5 = 3 THEN 404 ELSE 200 END AS status_code FROM (SELECT page_id, regexp_extract(url,'^(https?://[^/?#]+)',1) AS o FROM pages) a
 UNION ALL SELECT DISTINCT concat(o,'/js/',CAST(page_id % 8 AS VARCHAR(10)),'.js'), CASE page_id % 8 WHEN 7 THEN 410 WHEN 6 THEN 500 WHEN 5 THEN 0 ELSE 200 END FROM (SELECT page_id, regexp_extract(url,'^(https?://[^/?#]+)',1) AS o FROM pages) b
 UNION ALL SELECT DISTINCT concat(o,'/img/',CAST(page_id % 40 AS VARCHAR(10)),'.png'), CASE WHEN page_id % 40 < 4 THEN 404 ELSE 200 END FROM (SELECT page_id, regexp_extract(url,'^(https?://[^/?#]+)',1) AS o FROM pages) c
"""

VIEWS["hosts_obs"] = """
SELECT host, length(host) % 6 <> 0 AS handshake_ok, DATE '2024-01-01' + CAST(length(host) * 7 - 160 AS INT) AS not_after,
 CASE WHEN length(host) % 4 = 0 THEN concat('CN=',host) ELSE 'CN=Test CA' END AS issuer, concat('CN=',host) AS subject,
 CASE WHEN length(host) % 5 = 0 THEN 'mismatch.example.org' ELSE concat('*.',regexp_replace(host,'^[^.]+[.]','')) END AS san,
 CASE WHEN length(host) % 7 = 0 THEN 'UntrustedRoot: x' END AS chain_error,
 CASE WHEN length(host) % 3 = 0 THEN '10.0.0.5' ELSE concat('203.0.113.',CAST(length(host) AS VARCHAR(10))) END AS ip,
 concat('Domain: ',host,chr(10),'created: 2019-0',CAST(length(host) % 9 + 1 AS VARCHAR(10)),'-11',chr(10),'paid-till: 2024-0',CAST(length(host) % 5 + 1 AS VARCHAR(10)),'-11T00:00:00Z') AS whois_raw,
 concat('{"lighthouseResult":{"finalUrl":"https://',host,'/","categories":{"performance":{"score":',CAST(length(host) % 10 AS VARCHAR(10)),'e-1}},"audits":{"speed-index":{"numericValue":',CAST(length(host) * 100 AS VARCHAR(10)),'}}}}') AS psi_json
FROM (SELECT DISTINCT host FROM pages_ext) h
"""

VIEWS["site_edges"] = """
SELECT host, src, dst FROM (SELECT host, url AS src, lead(url) OVER (PARTITION BY host ORDER BY page_id) AS dst FROM pages_ext) a WHERE dst IS NOT NULL
 UNION ALL SELECT host, url, first_url FROM (SELECT host, url, page_id, min(page_id) OVER (PARTITION BY host) AS m, first_value(url) OVER (PARTITION BY host ORDER BY page_id) AS first_url FROM pages_ext) b WHERE page_id > m
 UNION ALL SELECT host, first_url, dst FROM (SELECT host, page_id, url AS dst, min(page_id) OVER (PARTITION BY host) AS m, first_value(url) OVER (PARTITION BY host ORDER BY page_id) AS first_url FROM pages_ext) c WHERE page_id > m AND page_id % 3 = 0
"""

VIEWS["psi_obs"] = """
SELECT host, strategy, url, CASE WHEN (seq + k) % 31 = 0 THEN NULL WHEN (seq + k) % 29 = 0 THEN '<html>quota</html>' ELSE concat('{"lighthouseResult":{"finalUrl":"',url,'#f","categories":{"performance":{"score":',CASE WHEN (seq + k) % 37 = 0 THEN 'null' ELSE concat(CAST((seq * 7 + k * 13) % 101 AS VARCHAR(10)),'e-2') END,'}},"audits":{"first-contentful-paint":{"numericValue":',CAST(seq % 900 AS VARCHAR(10)),'},"speed-index":{"numericValue":',CAST(seq % 700 AS VARCHAR(10)),'.5},"cumulative-layout-shift":{"numericValue":0.25}}}}') END AS psi_json
 FROM (SELECT host, original_url AS url, seq, 'MOBILE' AS strategy, 1 AS k FROM fetches UNION ALL SELECT host, original_url, seq, 'DESKTOP', 2 FROM fetches) p
"""

VIEWS["sitemap_files"] = """
SELECT host, concat('https://',host,CASE WHEN nth = 1 AND length(host) % 2 = 0 THEN '/sitemap.xml' ELSE concat('/sm/',CAST(page_id AS VARCHAR(10)),'.xml') END) AS url, CASE WHEN page_id % 13 = 0 THEN 500 ELSE 200 END AS status_code,
 CASE page_id % 7 WHEN 0 THEN concat('<?xml version="1.0"?><sitemapindex><sitemap><loc>https://',host,'/sm/1.xml</loc></sitemap><sitemap><loc> </loc></sitemap></sitemapindex>')
  WHEN 1 THEN '<html><loc>no</loc></html>' WHEN 2 THEN '<urlset><url><loc>x</loc>' WHEN 3 THEN concat('<s:urlset><s:url><s:loc>ftp/x</s:loc></s:url><s:url><s:loc> ',url,' </s:loc></s:url></s:urlset>') WHEN 4 THEN ''
  ELSE concat('<urlset><url><loc><![CDATA[',url,']]></loc><image:image><image:loc>https://',host,'/i.png</image:loc></image:image></url><!-- <url><loc>https://',host,'/c</loc></url> --><url><loc>https://',host,'/f.pdf</loc></url></urlset>') END AS body
 FROM (SELECT host, page_id, url, row_number() OVER (PARTITION BY host ORDER BY page_id) AS nth FROM pages_ext) s
"""

VIEWS["length_obs"] = """
SELECT host, event_id AS seq, CAST(CASE WHEN event_id % 211 = 0 THEN 0 WHEN event_id % 20 < length(host) % 9 + 10 AND event_id > 900 THEN 2048 ELSE body_size END AS BIGINT) AS content_length FROM probes
"""

VIEWS["host_ips"] = """
SELECT DISTINCT host, CASE seq % 13 WHEN 0 THEN '10.0.0.7' WHEN 1 THEN '172.31.4.4' WHEN 2 THEN 'fe80::1' WHEN 3 THEN 'fd12:3456::9' WHEN 4 THEN '::1' WHEN 5 THEN 'ff02::1' WHEN 6 THEN '2001:0:53aa::1' WHEN 7 THEN '224.0.0.1'
  WHEN 8 THEN '2001:db8::5' WHEN 9 THEN '2a00:1450::12' WHEN 10 THEN '198.51.100.4' WHEN 11 THEN '203.0.113.77' ELSE '172.32.0.1' END AS ip FROM fetches
"""

VIEWS["variant_hosts"] = """
SELECT page_id AS seq, concat(CASE WHEN page_id % 5 = 0 THEN 'www.' ELSE '' END,'s',CAST(page_id AS VARCHAR(10)),'.example.org') AS host, concat('s',CAST(page_id AS VARCHAR(10)),'.example.org') AS naked FROM pages
"""

VIEWS["variant_hops"] = """
SELECT concat('http://',naked,'/') AS from_url, concat('https://',host,'/') AS location FROM variant_hosts WHERE seq % 3 <> 1
 UNION ALL SELECT concat('http://www.',naked,'/'), concat('http://',naked,'/') FROM variant_hosts
 UNION ALL SELECT concat('https://',CASE WHEN host = naked THEN 'www.' ELSE '' END,naked,'/'), concat('https://',host,'/') FROM variant_hosts WHERE seq % 4 <> 2
"""

VIEWS["hop_chains"] = """
SELECT concat(url,'#',CAST(k AS VARCHAR(10))) AS from_url, CASE WHEN k + 1 = page_id % 14 AND page_id % 5 = 0 THEN concat(url,'#',CAST(page_id % 3 AS VARCHAR(10))) WHEN k + 1 = page_id % 14 THEN url ELSE concat(url,'#',CAST(k + 1 AS VARCHAR(10))) END AS location
 FROM pages JOIN (SELECT DISTINCT page_id % 14 AS k FROM pages) s ON k < page_id % 14
"""

VIEWS["robots_fetches"] = """
SELECT h.host, f.scheme, f.status_code, f.body, k FROM (SELECT host, min(page_id) AS k FROM pages_ext GROUP BY host) h JOIN (
 SELECT 0 AS case_, 'https' AS scheme, 200 AS status_code, concat('User-agent: *',chr(10),'Disallow: /x') AS body UNION ALL SELECT 1, 'https', 404, '' UNION ALL SELECT 1, 'http', 200, concat('User-agent: *',chr(10),'Disallow: /')
 UNION ALL SELECT 2, 'https', 404, '' UNION ALL SELECT 2, 'http', 404, '' UNION ALL SELECT 3, 'https', 500, '' UNION ALL SELECT 3, 'http', 403, '' UNION ALL SELECT 4, 'https', 0, NULL UNION ALL SELECT 4, 'http', 404, ''
 UNION ALL SELECT 6, 'https', 200, concat('User-agent: otherbot',chr(10),'Disallow: /') UNION ALL SELECT 7, 'https', 200, concat('User-agent: MyCrawler',chr(10),'Disallow: /') UNION ALL SELECT 7, 'http', 200, ''
 ) f ON h.k % 8 = f.case_
"""

VIEWS["robots_texts"] = """
SELECT host, CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN '# a comment' WHEN 2 THEN 'Disallow: /x' WHEN 3 THEN concat('User-agent:',chr(10),'Disallow: /x') WHEN 4 THEN 'User-agent: *' ELSE 'Sitemap: /s.xml' END AS body, k FROM (SELECT host, min(page_id) AS k FROM pages_ext GROUP BY host) h
"""

VIEWS["domain_obs"] = """
SELECT page_id, concat('d',CAST(page_id AS VARCHAR(10)),'.example') AS host, page_id % 3 > 0 AS with_created, page_id % 4 AS end_, page_id % 11 = 0 AS silent FROM pages
"""

VIEWS["whois_obs"] = """
SELECT page_id, host, CASE WHEN silent THEN '' ELSE concat('domain: ',host,CASE WHEN with_created THEN concat(chr(10),'created: 2019-03-04') ELSE '' END,CASE end_ WHEN 1 THEN concat(chr(10),'paid-till: 2023-12-31') WHEN 2 THEN concat(chr(10),'paid-till: 2024-02-01') WHEN 3 THEN concat(chr(10),'paid-till: 2030-01-01') ELSE '' END) END AS whois_raw FROM domain_obs
"""

VIEWS["rdap_obs"] = """
SELECT page_id, host, CASE WHEN silent THEN NULL ELSE concat('{"events":[',CASE WHEN page_id % 7 = 0 THEN '7,' ELSE '' END,'{"eventAction":"last changed","eventDate":"2020-01-01"}',CASE WHEN with_created THEN ',{"eventAction":"registration","eventDate":"2019-03-04T00:00:00Z"}' ELSE '' END,
 CASE end_ WHEN 1 THEN ',{"eventAction":"expiration","eventDate":"2023-12-31"}' WHEN 2 THEN ',{"eventAction":"expiration","eventDate":"2024-02-01"}' WHEN 3 THEN ',{"eventAction":"expiration","eventDate":"2030-01-01"}' ELSE '' END,'],"entities":[{"country":"x"},{"country":"',CASE WHEN page_id % 2 = 0 THEN 'nl' ELSE 'none' END,'"}]}') END AS json FROM domain_obs
"""

VIEWS["suffix_hosts"] = """
SELECT DISTINCT concat(CASE page_id % 4 WHEN 0 THEN 'a.b.' WHEN 1 THEN 'x.' ELSE '' END,CASE page_id % 6 WHEN 0 THEN 'shop.co.uk' WHEN 1 THEN 'www.ck' WHEN 2 THEN 'shop.ck' WHEN 3 THEN 'city.kobe.jp' WHEN 4 THEN host ELSE 'co.uk' END) AS host FROM pages_ext
"""

VIEWS["suffix_rules"] = """
SELECT DISTINCT rule FROM (SELECT regexp_extract(host,'([^.]+)$',1) AS rule FROM pages_ext UNION ALL SELECT regexp_extract(host,'([^.]+[.][^.]+)$',1) FROM pages_ext WHERE page_id % 5 = 0) p UNION ALL SELECT 'uk' UNION ALL SELECT 'co.uk' UNION ALL SELECT '*.ck' UNION ALL SELECT '!www.ck' UNION ALL SELECT 'jp' UNION ALL SELECT '*.kobe.jp' UNION ALL SELECT '!city.kobe.jp'
"""

VIEWS["robots_many"] = """
SELECT DISTINCT host, CASE WHEN length(host) % 3 = 0 AND page_id % 4 = 0 THEN 'mycrawler' WHEN page_id % 31 = 0 THEN 'otherbot' ELSE '*' END AS agent, page_id % 3 = 0 AS allow,
 CASE page_id % 7 WHEN 0 THEN concat(path,'$') WHEN 1 THEN concat('/*',substr(path,5)) WHEN 2 THEN substr(path,1,5) WHEN 3 THEN concat(substr(path,1,4),'*',substr(path,length(path),1),'$') WHEN 4 THEN '/*?' WHEN 5 THEN concat('*',substr(path,length(path)-1,2)) ELSE path END AS pattern
 FROM (SELECT page_id, host, regexp_extract(url,'^https?://[^/?#]+([^#]*)',1) AS path FROM pages_ext) p
"""

VIEWS["sitemap_xml_files"] = """
SELECT host, page_id AS nth, concat('https://',host,'/sm/',CAST(page_id AS VARCHAR(10)),'.xml') AS url,
 CASE page_id % 11 WHEN 0 THEN concat('<?xml version="1.0" encoding="ISO-8859-1"?>',chr(10),'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>',xml,'</loc></url></urlset>')
  WHEN 1 THEN concat('<s:urlset xmlns:s="x"><s:url><s:loc> ',xml,' </s:loc></s:url><s:url><s:lastmod>2024</s:lastmod><s:loc>ftp/x</s:loc></s:url></s:urlset>')
  WHEN 2 THEN concat('<!DOCTYPE urlset [<!ENTITY site "https://',host,'">]><urlset><url><loc>&site;/e&#38;&#x41;</loc></url></urlset>')
  WHEN 3 THEN concat('<urlset xmlns:image="i"><url><image:image><image:loc>no</image:loc></image:image><loc><![CDATA[',url,']]></loc></url><!-- <url><loc>no</loc></url> --></urlset>')
  WHEN 4 THEN concat('<sitemapindex><sitemap><loc>https://',host,'/a.xml</loc></sitemap><sitemap><loc> </loc></sitemap><sitemap><loc>b.xml</loc></sitemap></sitemapindex>')
  WHEN 5 THEN concat('<urlset><url><loc>',xml,'</loc></url>') WHEN 6 THEN concat('<urlset><url><loc>',xml,'</loc><image:loc>x</image:loc></url></urlset>')
  WHEN 7 THEN '<html><loc>no</loc></html>' WHEN 8 THEN ' ' WHEN 9 THEN concat('<urlset><url><loc>',xml,'</url></loc></urlset>')
  ELSE concat('<!-- c --><URLSET><URL><LOC>',xml,'</LOC><loc>second</loc></URL></URLSET>') END AS body
 FROM (SELECT page_id, host, url, replace(url,'&','&amp;') AS xml FROM pages_ext) p
"""

TABLES = ["pages", "documents", "events", "labels"]


def chain(query: str, made: dict[str, str] | None = None) -> str:
    """The query with the views that it needs, and those that these need, in front."""
    views = VIEWS | (made or {})
    needed: list[str] = []
    open_: list[str] = []  # a recursive view reads itself

    def add(sql: str) -> None:
        for name in views:
            if name not in needed and name not in open_ and re.search(rf"\b(FROM|JOIN) {name}\b", sql):
                open_.append(name)
                add(views[name])
                if name not in needed:
                    needed.append(name)

    add(query)
    recursive = any(re.search(rf"\b(FROM|JOIN) {n}\b", views[n]) for n in needed)
    return ("WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(f"{n} AS ({views[n]})" for n in needed) + "\n" if needed else "") + query


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or one of the driver's."""
    if name in VIEWS:
        sql = chain(f"SELECT * FROM {name}")
        used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"(FROM|JOIN) {t}\b", sql)}
        for t in used:
            sql = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        return spark.sql(_braces(sql, used), **used)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _braces(sql: str, used: dict) -> str:
    """Braces in literals are not parameters."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        sql = sql.replace("{{" + t + "}}", "{" + t + "}")
    return sql
