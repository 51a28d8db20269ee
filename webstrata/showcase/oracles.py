"""The registered queries in SQL, as DuckDB runs it over the same tables."""

from __future__ import annotations

from webstrata import settings
from webstrata.showcase.queries import SHORT_PAGE, STOP_WORDS

WORD = r"[\p{L}\p{N}_]+"
LONG_WORD = r"[\p{L}\p{N}_]{2,}"
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def dom(url: str) -> str:
    return (
        rf"replace(regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), 'www.', '')"
    )


def label(url: str) -> str:
    return f"CAST(starts_with({dom(url)}, 'blog.') AS BIGINT)"


def clean(html: str) -> str:
    return (
        rf"regexp_replace({html}, '(?is)<!--.*?-->|(<(?:script|style)[^>]*>).*?</(?:script|style)\s*>',"
        r" '\1', 'g')"
    )


def url_columns(url: str) -> str:
    path = (
        rf"regexp_replace(regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1),"
        " ';[^/]*$', '')"
    )
    suffix = " OR ".join(f"ends_with({dom(url)}, '{s}')" for s in settings.DEV_SUFFIXES)
    return f"""
      CAST(length({url}) AS BIGINT) AS url_len,
      CAST(length({dom(url)}) AS BIGINT) AS domain_len,
      CASE WHEN {path} = '/' THEN 0
           ELSE len(string_split(trim({path}, '/'), '/')) END::BIGINT AS path_depth,
      CAST({suffix} AS BIGINT) AS is_dev_tld,
      CAST(contains({dom(url)}, 'github.io') AS BIGINT) AS is_github_io,
      CAST(contains({dom(url)}, 'neocities.org') AS BIGINT) AS is_neocities"""


def structural(source: str) -> str:
    """Features of ``source(page_id, html)``."""
    return rf"""
    WITH c AS (SELECT page_id, {clean('html')} AS html FROM ({source})),
    g AS (SELECT *, list_filter(regexp_extract_all(html, '(?i)<meta\s[^>]*>'),
                 lambda m: regexp_matches(m, '\sname="generator"'))[1] AS tag FROM c),
    v AS (SELECT *, lower(regexp_extract(coalesce(tag, ''), 'content="([^"]*)"', 1)) AS gen,
                 (tag IS NOT NULL AND NOT contains(tag, 'content=')) AS bad FROM g)
    SELECT page_id,
      CASE WHEN bad THEN 0 ELSE contains(gen, 'hugo')::INT END::BIGINT AS generator_is_hugo,
      CASE WHEN bad THEN 0 ELSE contains(gen, 'jekyll')::INT END::BIGINT AS generator_is_jekyll,
      CASE WHEN bad THEN 0 ELSE contains(gen, 'wordpress')::INT END::BIGINT AS generator_is_wordpress,
      CASE WHEN bad THEN 0
           ELSE regexp_matches(html, '(?i)<script[^>]*\ssrc="[^"]*js\.hs-scripts\.com')::INT
      END::BIGINT AS has_hubspot_script,
      CASE WHEN bad THEN 0 ELSE len(regexp_extract_all(html, '(?i)<a[\s/>]')) END::BIGINT AS link_count,
      CASE WHEN bad THEN 0 ELSE len(regexp_extract_all(html, '(?i)<form[\s/>]')) END::BIGINT AS form_count
    FROM v"""


MARKED_PAGES = """
  SELECT page_id,
    CASE length(html) % 5
      WHEN 0 THEN '<meta name="generator" content="Hugo 0.1">'
      WHEN 1 THEN '<meta name="generator" content="WordPress"><meta name="generator" content="Hugo">'
      WHEN 2 THEN '<meta name="Generator" content="Jekyll">'
      WHEN 3 THEN '<META content="Jekyll v4" name="generator">'
      ELSE '<meta name="generator">' END
    || CASE length(url) % 3
      WHEN 0 THEN '<script async src="//js.hs-scripts.com/1.js"></script>'
      WHEN 1 THEN '<script>"js.hs-scripts.com <a> </p>"</script>'
      ELSE '<!-- <form> -->' END
    || html || repeat('<form action="/s"><a name="x">y</a></form><FORM>', length(url) % 4) AS html
  FROM pages"""

MARKED_URLS = """
  SELECT page_id, replace(replace(replace(url, 'example.com', 'github.io'), 'example.org', 'joe.dev'),
                          'example.net', 'www.neocities.org') AS url FROM pages"""

MARKED_TEXT = """
  SELECT doc_id, replace(replace(replace(replace(text, ' the ', ' We '), ' of ', ' my '),
                 ' and ', ' services, '), ' la ', ' i-b2b ') AS text FROM documents"""


def word_count(text: str, words: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return (
        f"CAST(len(list_filter(regexp_extract_all(lower({text}), '{WORD}'),"
        f" lambda w: list_contains([{listed}], w))) AS BIGINT)"
    )


def content_columns(text: str) -> str:
    return f"""
      {word_count(text, settings.PERSONAL_PRONOUNS)} AS personal_pronoun_count,
      {word_count(text, settings.CORPORATE_PRONOUNS)} AS corporate_pronoun_count,
      {word_count(text, settings.CORPORATE_KEYWORDS)} AS corporate_keyword_count"""


def unescaped(text: str) -> str:
    pairs = (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
    for name, char in pairs:
        text = f"replace({text}, '{name}', '{char}')"
    return text


def squeezed(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SPACE}+', ' ', 'g'))"


def leaf_rows() -> str:
    parts = []
    for tag in ("li", "h1"):
        bodies = (
            f"regexp_extract_all({clean('html')}, "
            rf"'(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>', 1)"
        )
        inner = rf"regexp_replace(b, '\s*<[^>]*>\s*', '', 'g')"
        texts = (
            f"list_filter(list_transform({bodies}, lambda b: {squeezed(unescaped(inner))}),"
            " lambda t: t <> '')"
        )
        parts.append(
            f"SELECT page_id, '{tag}' AS tag, CAST(i - 1 AS BIGINT) AS pos, t[i] AS text FROM"
            f" (SELECT page_id, t, unnest(range(1, len(t) + 1)) AS i FROM"
            f" (SELECT page_id, {texts} AS t FROM pages))"
        )
    return " UNION ALL ".join(parts)


def trimmed(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


# Tags and text pieces in order; an element ends at the end tag that brings the depth of its
# name back, or, as paragraphs of the stored pages may stay open, with its article.
_NAMES = ", ".join(f"'{t}'" for t in settings.BLOCK_TAGS)
PAGE_BLOCKS = rf"""
  WITH t AS MATERIALIZED (
    SELECT page_id, idx, tok, regexp_extract(lower(tok), '^</?([a-z][a-z0-9]*)', 1) AS name,
           CASE WHEN starts_with(tok, '</') THEN -1 WHEN starts_with(tok, '<') THEN 1 ELSE 0 END AS kind
    FROM (SELECT page_id, toks[idx] AS tok, idx FROM
      (SELECT page_id, toks, unnest(range(1, len(toks) + 1)) AS idx FROM
        (SELECT page_id, regexp_extract_all({clean('html')}, '<[^>]*>|[^<]+') AS toks FROM pages)))),
  m AS MATERIALIZED (
    SELECT *, sum(kind) OVER (PARTITION BY page_id, name ORDER BY idx) AS depth
    FROM t WHERE name IN ({_NAMES})),
  o AS MATERIALIZED (
    SELECT page_id, idx, name,
      coalesce((SELECT min(c.idx) FROM m c WHERE c.page_id = m.page_id AND c.name = m.name
                AND c.kind = -1 AND c.idx > m.idx AND c.depth = m.depth - 1),
               (SELECT min(c.idx) FROM m c WHERE c.page_id = m.page_id AND c.name = 'article'
                AND c.kind = -1 AND c.idx > m.idx)) AS until
    FROM m WHERE kind = 1),
  x AS (SELECT page_id, idx, {trimmed(unescaped('tok'))} AS piece FROM t WHERE kind = 0),
  b AS (SELECT o.page_id, o.idx, o.name AS tag,
               {squeezed("string_agg(x.piece, '' ORDER BY x.idx)")} AS text
        FROM o JOIN x ON x.page_id = o.page_id AND x.idx > o.idx AND x.idx < o.until
        GROUP BY 1, 2, 3)
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY idx) - 1 AS BIGINT) AS pos,
         tag, text FROM b WHERE text <> ''"""


# Root-relative references only, as the stored pages hold them; fragments are cut.
def edges(source: str = "pages") -> str:
    href = rf"regexp_extract_all({clean('html')}, '(?i)<a\s[^>]*href=\"([^\"]*)\"', 1)"
    origin = r"regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)"
    return (
        f"SELECT DISTINCT url AS src_url, {origin} || string_split({unescaped('h')}, '#')[1] AS dst_url,"
        f" {dom('url')} AS domain"
        f" FROM (SELECT url, unnest({href}) AS h FROM {source})"
        " WHERE NOT regexp_matches(h, '^(#|mailto:|tel:)')"
    )


SEEDS = f"""
  SELECT {dom('url')} AS domain, arg_min(url, page_id) AS url, {label('arg_min(url, page_id)')} AS label
  FROM pages GROUP BY 1"""


def expansion(edge_sql: str, seed_sql: str, levels: int, quota: int = settings.MAX_LINKS) -> str:
    """Level by level, each level within the domain's remaining quota."""
    steps = [
        f"e AS MATERIALIZED ({edge_sql})",
        f"l0 AS MATERIALIZED (SELECT domain, url, 0 AS depth FROM ({seed_sql}))",
        "v0 AS MATERIALIZED (SELECT * FROM l0)",
    ]
    for i in range(1, levels + 1):
        steps.append(
            f"""l{i} AS MATERIALIZED (
            SELECT domain, url, {i} AS depth FROM (
              SELECT c.domain, c.url, row_number() OVER (PARTITION BY c.domain ORDER BY c.url) AS rn,
                     {quota} - q.used AS room
              FROM (SELECT DISTINCT l.domain, e.dst_url AS url FROM l{i-1} l JOIN e ON e.src_url = l.url) c
              JOIN (SELECT domain, count(*) AS used FROM v{i-1} GROUP BY domain) q ON q.domain = c.domain
              WHERE NOT EXISTS (SELECT 1 FROM v{i-1} v WHERE v.url = c.url))
            WHERE rn <= room)"""
        )
        steps.append(
            f"v{i} AS MATERIALIZED (SELECT * FROM v{i-1} UNION ALL SELECT * FROM l{i})"
        )
    return "WITH " + ",\n".join(steps) + f"\nSELECT * FROM v{levels}"


ORDER_PAGES = """
  SELECT k AS page_id, 'https://' || site || '.example.com/o/' || k AS url, site || '.example.com' AS domain,
         'https://' || site || '.example.com/o/' AS stem, k
  FROM (SELECT o_orderkey AS k,
               's' || CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 50 END AS site FROM orders)"""
ORDER_EDGES = f"""
  SELECT url AS src_url, stem || (k + unnest([150, 300, 1050])) AS dst_url, domain FROM ({ORDER_PAGES})"""
ORDER_SEEDS = f"SELECT domain, arg_min(url, page_id) AS url FROM ({ORDER_PAGES}) GROUP BY domain"

# URL list: stored pages and what their sites link to.
LISTED = f"""
  SELECT url, {label('url')} AS label FROM
    (SELECT url FROM pages UNION SELECT dst_url FROM ({edges()}))"""
DONE = "SELECT url FROM pages WHERE starts_with(url, 'http://')"
TO_DO = f"SELECT * FROM ({LISTED}) WHERE url NOT IN ({DONE})"

SEED_LISTS = """
  SELECT url, page_id AS pos, CASE WHEN starts_with(url, 'https://') THEN 1 ELSE 0 END AS source
  FROM pages"""


def seed_sql(live: bool) -> str:
    condition = f"WHERE url IN (SELECT url FROM pages WHERE length(html) >= {SHORT_PAGE})" if live else ""
    return f"""
    SELECT domain, url, CAST(source AS BIGINT) AS label, CAST({settings.MAX_LINKS} AS BIGINT) AS max_links
    FROM (SELECT *, {dom('url')} AS domain,
                 row_number() OVER (PARTITION BY {dom('url')} ORDER BY source, pos) AS rn
          FROM ({SEED_LISTS}) {condition})
    WHERE rn = 1 AND domain <> ''"""


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
WORDS = f"""
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{LONG_WORD}'),
                             lambda w: NOT list_contains([{_STOP}], w)) AS words FROM documents"""
GRAMS = f"""
  SELECT doc_id, list_concat(words, list_transform(range(1, len(words)),
                 lambda i: words[i] || ' ' || words[i + 1])) AS terms FROM ({WORDS})"""
_FLAT = f"regexp_replace(lower(url), '{SPACE}{{2,}}', ' ', 'g')"
CHAR_GRAMS = "SELECT page_id AS doc_id, list_concat(list_concat({}), {}) AS terms FROM (SELECT page_id, {} AS s FROM pages)".format(
    ", ".join(f"list_transform(range(1, length(s) - {n} + 2), lambda i: substr(s, i, {n}))" for n in (3, 4)),
    "list_transform(range(1, length(s) - 5 + 2), lambda i: substr(s, i, 5))",
    _FLAT,
)


def stats(terms_sql: str, column: str = "terms") -> str:
    return f"""
    SELECT term, CAST(count(*) AS BIGINT) AS tf, CAST(count(DISTINCT doc_id) AS BIGINT) AS df
    FROM (SELECT doc_id, unnest({column}) AS term FROM ({terms_sql})) GROUP BY term"""


def tfidf_sql(terms_sql: str, key: str, size: int) -> str:
    return f"""
    WITH d AS MATERIALIZED ({terms_sql}),
    vocab AS (SELECT term, ln((1.0 + (SELECT count(*) FROM d)) / (1 + df)) + 1 AS idf
              FROM ({stats('SELECT * FROM d')}) ORDER BY tf DESC, term LIMIT {size}),
    w AS (SELECT doc_id, term, count(*) * any_value(idf) AS w
          FROM (SELECT doc_id, unnest(terms) AS term FROM d) JOIN vocab USING (term) GROUP BY 1, 2)
    SELECT doc_id AS {key}, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight
    FROM w"""


def fraction(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0)"


REPORT = """
  WITH c AS (SELECT k AS class,
                    (SELECT count(*) FROM labels WHERE quality = k) AS support,
                    (SELECT count(*) FROM labels WHERE toxic = k) AS predicted,
                    (SELECT count(*) FROM labels WHERE quality = k AND toxic = k) AS hits
             FROM (SELECT DISTINCT quality AS k FROM labels UNION SELECT DISTINCT toxic FROM labels)),
  m AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END AS p,
                  CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS r FROM c),
  f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM m)
  SELECT name, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
         CAST(support AS BIGINT) AS support
  FROM (SELECT CAST(class AS VARCHAR) AS name, p, r, f, support FROM f
        UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support),
                         sum(hits) / sum(support), sum(support) FROM f
        UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM f
        UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
                         sum(f * support) / sum(support), sum(support) FROM f)"""

LISTED_CHARS = f"""
  SELECT url, label, CAST(length(html) AS BIGINT) AS html_chars
  FROM ({LISTED}) JOIN (SELECT url, html FROM pages WHERE html IS NOT NULL) USING (url)"""


def all_oracles() -> dict[str, str]:
    bare = "regexp_replace(url, '^https://', '')"
    found = {
        "scan_project": "SELECT page_id, url FROM pages",
        "page_count": "SELECT count(*) AS pages FROM pages",
        "std_url": f"SELECT page_id, CASE WHEN starts_with({bare}, 'http') THEN {bare}"
        f" ELSE 'https://' || {bare} END AS url FROM pages",
        "domain": f"SELECT page_id, {dom('url')} AS domain FROM pages",
        "url_features": f"SELECT page_id, {url_columns('url')} FROM pages",
        "url_features_invalid": f"SELECT page_id, {url_columns('url')} FROM (SELECT page_id,"
        " CASE page_id % 4 WHEN 2 THEN 'a.com/x/y' ELSE url END AS url FROM pages WHERE page_id % 4 > 1)"
        " UNION ALL SELECT page_id, 0, 0, 0, 0, 0, 0 FROM pages WHERE page_id % 4 < 2",
        "structural_features_null": structural("SELECT page_id, html FROM pages WHERE page_id % 5 <> 0")
        + " UNION ALL SELECT page_id, 0, 0, 0, 0, 0, 0 FROM pages WHERE page_id % 5 = 0",
        "fetch_status_null": "SELECT url, 'failed' AS status, CAST(NULL AS VARCHAR) AS html_content"
        " FROM pages WHERE page_id % 5 = 0",
        "url_features_marked": f"SELECT page_id, {url_columns('url')} FROM ({MARKED_URLS})",
        "suffix_flags": f"SELECT page_id, CAST(ends_with({dom('url')}, '.net') OR"
        f" ends_with({dom('url')}, '.org') AS BIGINT) AS flag FROM pages",
        "structural_features": structural("SELECT page_id, html FROM pages"),
        "structural_features_marked": structural(MARKED_PAGES),
        "tag_counts": "SELECT page_id, "
        + ", ".join(
            rf"CAST(len(regexp_extract_all({clean('html')}, '(?i)<{t}[\s/>]')) AS BIGINT) AS {t}_count"
            for t in ("li", "p", "b")
        )
        + " FROM pages",
        "content_features": f"SELECT doc_id, {content_columns('text')} FROM documents",
        "content_features_marked": f"SELECT doc_id, {content_columns('text')} FROM ({MARKED_TEXT})",
        "word_set_counts": "SELECT doc_id, "
        + ", ".join(f"{word_count('text', (w,))} AS {w}_count" for w in ("the", "of", "la", "é"))
        + f", {word_count('text', ('the', 'of', 'and'))} AS all_count FROM documents",
        "norm_text": f"SELECT doc_id, {squeezed('text')} AS text FROM documents",
        "leaf_blocks": leaf_rows(),
        "text_blocks": PAGE_BLOCKS,
        "text_content": "SELECT page_id, CAST(length(t) AS BIGINT) AS chars, md5(t) AS digest FROM"
        " (SELECT page_id, string_agg(text, ' ' ORDER BY pos) AS t"
        f" FROM ({PAGE_BLOCKS}) GROUP BY page_id)",
        "text_block_headings": f"SELECT page_id, tag, text, count(*) AS n FROM ({leaf_rows()})"
        " GROUP BY ALL",
        "dense_features": f"""
          SELECT p.url, {url_columns('p.url')}, s.* EXCLUDE (page_id), {content_columns("coalesce(c.t, '')")}
          FROM pages p JOIN ({structural('SELECT page_id, html FROM pages')}) s ON s.page_id = p.page_id
          LEFT JOIN (SELECT page_id, string_agg(text, ' ' ORDER BY pos) AS t FROM ({PAGE_BLOCKS})
                     GROUP BY page_id) c ON c.page_id = p.page_id""",
        "label_names": f"SELECT page_id, {label('url')} AS label,"
        f" CASE {label('url')} WHEN 1 THEN 'personal_blog' ELSE 'corporate_seo' END AS label_name,"
        f" CASE {label('url')} WHEN 1 THEN 'Personal Blog' ELSE 'Corporate Seo' END AS display_name"
        " FROM pages",
        "decide": "SELECT event_id, CAST(p > 0.5 AS BIGINT) AS prediction,"
        " round(CASE WHEN p > 0.5 THEN p ELSE 1 - p END, 6) AS confidence,"
        " format('{:.2f}%', (CASE WHEN p > 0.5 THEN p ELSE 1 - p END) * 100) AS percent"
        " FROM (SELECT event_id, (user_id % 101) / CAST(100 AS DOUBLE) AS p FROM events)",
        "fingerprint": "SELECT doc_id, substr(sha256('{\"doc_id\":' || doc_id || ',\"quality\":' ||"
        " quality || ',\"toxic\":' || toxic || '}'), 1, 12) AS key FROM labels",
        "fingerprint_nulls": "SELECT doc_id, substr(sha256('{\"doc_id\":' || doc_id || ',\"quality\":' ||"
        " coalesce(quality::VARCHAR, 'null') || ',\"toxic\":' || coalesce(toxic::VARCHAR, 'null') || '}'), 1, 12) AS key"
        " FROM documents LEFT JOIN labels USING (doc_id)",
        "dropna": "SELECT d.doc_id, d.lang, CAST(l.quality AS BIGINT) AS quality,"
        " CAST(l.toxic AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)"
        " WHERE l.quality IS NOT NULL",
        "distinct_urls": f"SELECT DISTINCT dst_url AS url FROM ({edges()})",
        "seeds": seed_sql(live=False),
        "live_seeds": seed_sql(live=True),
        "seed_limit": "SELECT url, page_id FROM (SELECT url, page_id, row_number() OVER"
        " (PARTITION BY starts_with(url, 'https://') ORDER BY page_id) AS rn FROM pages)"
        f" WHERE rn <= {settings.DEBUG_SEEDS}",
        "planned_pages": "SELECT count(*) AS seeds, CAST(sum(max_links) AS BIGINT) AS planned_pages"
        f" FROM ({seed_sql(live=True)})",
        "domain_count": f"SELECT count(DISTINCT {dom('url')}) AS domains FROM pages",
        "pages_per_domain": f"SELECT {dom('url')} AS domain, count(*) AS pages FROM pages GROUP BY 1",
        "completeness": f"""
          WITH e AS (SELECT DISTINCT {dom('url')} AS d FROM pages),
          s AS (SELECT DISTINCT {dom('url')} AS d FROM pages WHERE length(html) >= {SHORT_PAGE}),
          n AS (SELECT (SELECT count(*) FROM e) AS expected_domains,
                       (SELECT count(*) FROM s) AS stored_domains,
                       (SELECT count(*) FROM e WHERE d NOT IN (SELECT d FROM s)) AS missing_domains,
                       (SELECT count(*) FROM pages WHERE length(html) >= {SHORT_PAGE}) AS stored_rows)
          SELECT *, CASE WHEN missing_domains = 0 THEN 'complete' ELSE 'incomplete' END AS status FROM n""",
        "label_dist": "SELECT CAST(quality AS BIGINT) AS label, count(*) AS n,"
        " round(count(*) / (SELECT count(*) FROM labels), 6) AS share,"
        " (SELECT count(DISTINCT quality) FROM labels) AS classes FROM labels GROUP BY quality",
        "links": f"SELECT src_url, dst_url FROM ({edges()})",
        "links_marked": f"SELECT src_url, dst_url FROM ({edges()})"
        " UNION SELECT url, 'https://elsewhere.test/p' FROM pages",
        "same_domain_links_marked": f"SELECT * FROM ({edges()}) WHERE {dom('dst_url')} = domain",
        "served_marked": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'text/html; charset=utf-8' ELSE 'text/html' END"
        " AS content_type FROM pages WHERE page_id % 4 IN (0, 2) AND page_id % 3 <> 1",
        "same_domain_links": f"SELECT * FROM ({edges()}) WHERE {dom('dst_url')} = domain",
        "quota_pages": f"SELECT page_id, domain, url FROM (SELECT page_id, {dom('url')} AS domain, url,"
        f" row_number() OVER (PARTITION BY {dom('url')} ORDER BY url) AS rn FROM pages)"
        f" WHERE rn <= {settings.MAX_LINKS}",
        "label_by_domain": f"SELECT p.page_id, p.url, s.domain, s.label FROM pages p"
        f" JOIN ({SEEDS}) s ON s.domain = {dom('p.url')}",
        "frontier_level1": f"SELECT domain, url, CAST(starts_with(domain, 'blog.') AS BIGINT) AS label"
        f" FROM ({expansion(edges(), SEEDS, 1)}) WHERE depth = 1",
        "frontier": "SELECT domain, url, CAST(starts_with(domain, 'blog.') AS BIGINT) AS label,"
        f" CAST(depth AS BIGINT) AS depth FROM ({expansion(edges(), SEEDS, settings.MAX_LINKS)})",
        "frontier_orders": "SELECT domain, url, CAST(depth AS BIGINT) AS depth"
        f" FROM ({expansion(ORDER_EDGES, ORDER_SEEDS, settings.MAX_LINKS)})",
        "quota_above_bound": "SELECT domain, url, CAST(depth AS BIGINT) AS depth"
        f" FROM ({expansion(ORDER_EDGES, ORDER_SEEDS, 40, 40)})",
        "enrich_join": LISTED_CHARS,
        "enriched_table": LISTED_CHARS,
        "ingest_stream": f"SELECT url, {label('url')} AS label, CAST(length(html) AS BIGINT) AS html_chars"
        " FROM pages WHERE html IS NOT NULL",
        "ingest_restart": f"SELECT url, {label('url')} AS label,"
        " CAST(length(html) + CASE WHEN page_id % 3 = 0 THEN 12 ELSE 0 END AS BIGINT) AS html_chars"
        " FROM pages WHERE html IS NOT NULL",
        "fetch_status": f"""
          SELECT url, label, CASE WHEN p.html IS NULL THEN 'failed'
            WHEN regexp_matches({clean('p.html')}, '(?is)<li>.*?[^<>\\s].*?</li>') THEN 'success'
            ELSE 'success_empty' END AS status
          FROM ({LISTED}) LEFT JOIN (SELECT url, html FROM pages) p USING (url)""",
        "resume_anti": TO_DO,
        "run_stats": f"""
          WITH t AS (SELECT html IS NOT NULL AS ok, length(url) % 4 > 0 AS tried FROM ({TO_DO})
                     LEFT JOIN (SELECT url, html FROM pages) p USING (url))
          SELECT count(*) FILTER (tried AND ok) AS success, count(*) FILTER (tried AND NOT ok) AS failed,
                 count(*) AS total, (SELECT count(*) FROM ({DONE})) AS skipped,
                 round(count(*) FILTER (tried) / count(*) * 100.0, 6) AS percent_done FROM t""",
        "url_list_csv": LISTED,
        "plain_list_csv": f"SELECT CASE WHEN starts_with({bare}, 'http') THEN {bare}"
        f" ELSE 'https://' || {bare} END AS url FROM pages",
        "named_list_csv": "SELECT url FROM pages",
        "tokens": f"SELECT doc_id, CAST(len(words) AS BIGINT) AS n,"
        f" md5(array_to_string(words, ' ')) AS digest FROM ({WORDS})",
        "ngrams": f"SELECT doc_id, CAST(len(terms) AS BIGINT) AS n,"
        f" md5(array_to_string(terms, '|')) AS digest FROM ({GRAMS})",
        "char_ngrams": f"SELECT doc_id AS page_id, CAST(len(terms) AS BIGINT) AS n,"
        f" md5(array_to_string(terms, '|')) AS digest FROM ({CHAR_GRAMS})",
        "term_df": stats(WORDS, "words"),
        "vocab_topk": f"{stats(GRAMS)} ORDER BY tf DESC, term LIMIT {settings.WORD_VOCABULARY}",
        "tfidf": tfidf_sql(GRAMS, "doc_id", settings.WORD_VOCABULARY),
        "char_tfidf": tfidf_sql(CHAR_GRAMS, "page_id", settings.CHAR_VOCABULARY),
        "split": f"SELECT page_id, {fraction('url')} < {settings.TEST_SHARE} AS is_test FROM pages",
        "split_by_domain": f"SELECT page_id, {fraction(dom('url'))} < {settings.TEST_SHARE} AS is_test"
        " FROM pages",
        "split_stratified": f"""
          SELECT page_id, row_number() OVER (PARTITION BY {label('url')} ORDER BY md5(url), url)
            <= round({settings.TEST_SHARE} * count(*) OVER (PARTITION BY {label('url')})) AS is_test
          FROM pages""",
        "split_parts": f"""
          SELECT page_id, CASE WHEN r <= t THEN 'test'
            WHEN r <= t + round(0.1 * (n - t)) THEN 'validation' ELSE 'train' END AS part
          FROM (SELECT *, round({settings.TEST_SHARE} * n) AS t FROM (
            SELECT page_id, row_number() OVER (PARTITION BY {label('url')} ORDER BY md5(url), url) AS r,
              count(*) OVER (PARTITION BY {label('url')}) AS n FROM pages))""",
        "split_parts_documents": """
          SELECT doc_id, CASE WHEN r <= t THEN 'test'
            WHEN r <= t + round(0.25 * (n - t)) THEN 'validation' ELSE 'train' END AS part
          FROM (SELECT *, round(0.3 * n) AS t FROM (
            SELECT doc_id, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id::varchar), doc_id::varchar) AS r,
              count(*) OVER (PARTITION BY toxic) AS n FROM labels))""",
        "class_report": REPORT,
        "confusion": "SELECT CAST(k AS BIGINT) AS label,"
        " (SELECT count(*) FROM labels WHERE quality = k AND toxic = 0) AS pred_0,"
        " (SELECT count(*) FROM labels WHERE quality = k AND toxic = 1) AS pred_1"
        " FROM (SELECT unnest([0, 1]) AS k)",
        "confusion_gaps": "WITH m AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 3 ELSE quality END AS l,"
        " CASE WHEN doc_id % 7 = 0 THEN 3 ELSE toxic * 2 END AS p FROM labels)"
        " SELECT CAST(k AS BIGINT) AS label, "
        + ", ".join(f"count(l) FILTER (l = k AND p = {c}) AS pred_{c}" for c in range(4))
        + " FROM (SELECT unnest([0, 1, 2, 3]) AS k) LEFT JOIN m ON TRUE GROUP BY k",
        "rate_30s": "SELECT strftime(time_bucket(INTERVAL 30 SECONDS, ts), '%Y-%m-%d %H:%M:%S') AS start,"
        " count(*) AS n, round(count(*) / 30.0, 6) AS rate FROM events GROUP BY 1",
    }
    found["null_fill"] = (
        "SELECT p.url, s.* EXCLUDE (page_id) FROM pages p JOIN ("
        + structural("SELECT page_id, html FROM pages WHERE length(url) % 5 <> 0")
        + " UNION ALL SELECT page_id, 0, 0, 0, 0, 0, 0 FROM pages WHERE length(url) % 5 = 0) s ON s.page_id = p.page_id"
    )
    found["class_guard"] = "SELECT count(*) AS n, count(DISTINCT quality) AS classes FROM labels WHERE quality IS NOT NULL"
    found["feature_widths"] = (
        f"SELECT url AS page_url, {settings.HASH_BUCKETS}::BIGINT AS text, {len(settings.URL_FEATURES)}::BIGINT AS url,"
        f" {len(settings.STRUCTURAL_FEATURES)}::BIGINT AS structural, {len(settings.CONTENT_FEATURES)}::BIGINT AS content,"
        f" {settings.HASH_BUCKETS + 15}::BIGINT AS total FROM pages"
    )
    found["report_json"] = found["report_csv"] = found["label_dist"]
    found["feature_store"] = found["dense_features"]
    found["std_url_blanks"] = found["std_url"]
    found["tag_counts_broken"] = found["tag_counts"]
    found["rate_30s_stream"] = found["rate_30s"]
    return found
