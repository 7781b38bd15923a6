"""Text, crawl and corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import evidence as O
from ..sources import documents as D
from ..sources import html as H
from .registry import ORACLES, query, table


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_PAIRS = "list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '')"


@query(rf"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || CASE WHEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]*([^?#]*)', 1) END
 || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END AS url FROM (SELECT page_id, url, list_filter({_PAIRS}, lambda p: NOT (lower(string_split(p, '=')[1]) LIKE 'utm\_%' ESCAPE '\' OR lower(string_split(p, '=')[1]) IN {_list(V.TRACKING_QUERY_KEYS)})) AS q FROM pages)""")
def url_normalize(spark, sf):
    """Page URLs without tracking keys and fragments."""
    return table(spark, sf, "pages").select("page_id", T.normalize_url(F.col("url")).alias("url"))


_ADMIT_URLS = """(SELECT page_id, CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN 'https://h.org/login/' || page_id WHEN 2 THEN 'https://h.org/a?action=edit&n=' || page_id WHEN 3 THEN 'https://h.org/wiki/Special:P' || page_id WHEN 4 THEN 'ftp://h.org/' || page_id WHEN 5 THEN 'https://h.org/w/index.php?title=Talk:x' || page_id ELSE 'https://h.org/wiki/Page_' || page_id END AS url FROM pages)"""


@query(rf"""SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?://[^/?#]') THEN 'unsupported_url'
 WHEN len(list_filter({_PAIRS}, lambda p: lower(string_split(p, '=')[1]) IN {_list(V.BLOCKED_QUERY_KEYS)})) > 0 THEN 'action_url'
 WHEN lower(regexp_extract(url, '[?&]title=([^:&#]*):', 1)) IN {_list(V.BLOCKED_WIKI_NAMESPACES)} THEN 'wiki_namespace'
 WHEN len(list_filter(string_split(lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)), '/'), lambda s: s IN {_list(V.BLOCKED_PATH_PARTS)})) > 0 THEN 'administrative_path'
 WHEN lower(regexp_extract(url, '/wiki/([^/?#:]+):', 1)) IN {_list(V.BLOCKED_WIKI_NAMESPACES)} THEN 'wiki_namespace' END AS reason FROM {_ADMIT_URLS}""")
def url_admission(spark, sf):
    """Reason to reject a URL. The supplied URLs hit no rule, so six of seven are rewritten to hit one each."""
    k, i = F.col("page_id") % 7, F.col("page_id").cast("string")
    made = F.when(k == 0, F.col("url"))
    for n, head in enumerate(("https://h.org/login/", "https://h.org/a?action=edit&n=", "https://h.org/wiki/Special:P", "ftp://h.org/", "https://h.org/w/index.php?title=Talk:x"), 1):
        made = made.when(k == n, F.concat(F.lit(head), i))
    made = made.otherwise(F.concat(F.lit("https://h.org/wiki/Page_"), i))
    return table(spark, sf, "pages").select("page_id", T.url_admission(made).alias("reason"))


@query(ORACLES["url_admission"].replace(_ADMIT_URLS, "pages"))
def url_admission_pages(spark, sf):
    """Reason to reject a URL, for the real URL of every page."""
    return table(spark, sf, "pages").select("page_id", T.url_admission(F.col("url")).alias("reason"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 50 = 1 OR (length(t) < 1500 AND contains(lower(t), 'verify you are human')) THEN 'challenge_page' WHEN t = '' THEN 'empty_content' WHEN length(t) < 120 THEN 'low_content' END AS reason
FROM (SELECT doc_id, trim(CASE WHEN doc_id % 50 = 2 THEN '  ' WHEN doc_id % 50 = 3 THEN 'Verify you are human ' || text ELSE text END) AS t FROM documents)""")
def page_admission(spark, sf):
    """Reason to reject a page's text; some titles and texts are made to be challenges or empty."""
    d, k = table(spark, sf, "documents"), F.col("doc_id") % 50
    text = F.when(k == 2, "  ").when(k == 3, F.concat(F.lit("Verify you are human "), F.col("text"))).otherwise(F.col("text"))
    return d.select("doc_id", T.page_admission(F.when(k == 1, "Just a Moment...").otherwise("A title"), text).alias("reason"))


@query(f"""SELECT doc_id, CASE WHEN length(t) < 1500 AND ({" OR ".join(f"contains(lower(t), '{m}')" for m in V.CHALLENGE_MARKERS)}) THEN 'challenge_page' WHEN t = '' THEN 'empty_content' WHEN length(t) < 120 THEN 'low_content' END AS reason
FROM (SELECT doc_id, trim(coalesce(text, '')) AS t FROM documents)""")
def page_admission_documents(spark, sf):
    """Reason to reject a text, for the real text of every document; documents have no titles."""
    return table(spark, sf, "documents").select("doc_id", T.page_admission(F.lit(None).cast("string"), F.col("text")).alias("reason"))


@query()
def page_admission_pages(spark, sf):
    """Reason to reject a page, by the real title and text of every page: parsing, not SQL."""
    return H.extract(table(spark, sf, "pages")).select("page_id", T.page_admission(F.col("title"), F.col("text")).alias("reason"))


@query(r"""WITH RECURSIVE l AS (SELECT doc_id, list_filter(list_transform(string_split(trim(text), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS x FROM documents),
s AS (SELECT doc_id, x, 0 AS k, '' AS held, CAST(NULL AS VARCHAR) AS done FROM l
UNION ALL SELECT doc_id, x, k + 1, CASE WHEN ends THEN '' ELSE h END, CASE WHEN ends OR k + 1 = len(x) THEN h END FROM (
  SELECT *, (length(h) >= 40 AND regexp_matches(h, '[.?!]\s*$')) OR length(h) >= 1200 AS ends FROM (SELECT *, CASE WHEN held = '' THEN x[k + 1] ELSE held || ' ' || x[k + 1] END AS h FROM s WHERE k < len(x))))
SELECT doc_id, count(*) AS n, sum(length(done))::BIGINT AS chars, max(length(done)) AS longest, min(length(done)) AS shortest FROM s WHERE done IS NOT NULL GROUP BY doc_id""")
def paragraphs(spark, sf):
    """Paragraphs rebuilt from lines: number, characters, longest and shortest."""
    found = table(spark, sf, "documents").select("doc_id", F.explode(T.paragraphs(F.col("text"))).alias("p"))
    size = F.length("p")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(size).alias("chars"), F.max(size).cast("long").alias("longest"), F.min(size).cast("long").alias("shortest"))


@query(r"""SELECT doc_id, CASE WHEN length(text) > 1500 THEN ceil(length(text) / 1200.0) ELSE 1 END::INT AS n FROM documents WHERE trim(text) <> ''""")
def paragraph_windows(spark, sf):
    """Windows of lone long texts."""
    return table(spark, sf, "documents").filter("trim(text) != ''").select("doc_id", F.size(T.windows(F.col("text"))).alias("n"))


_LINE_SQL = r"""l AS (SELECT doc_id, k, trim(x) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents))"""


@query(r"WITH " + _LINE_SQL + r""", h AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)""" + V.HEADING_PATTERN + r"""') AND length(line) <= 120 THEN 1 ELSE 0 END AS head FROM l),
s AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY k) AS section FROM h)
SELECT doc_id, section::BIGINT AS section, count(*) FILTER (line <> '' AND head = 0) AS lines, sum(CASE WHEN head = 0 THEN length(line) ELSE 0 END)::BIGINT AS chars, max(CASE WHEN head = 1 THEN line END) AS title FROM s GROUP BY ALL""")
def doc_structure(spark, sf):
    """Sections of a document by headings."""
    return D.structure(table(spark, sf, "documents")).groupBy("doc_id", "section").agg(
        F.count_if((F.col("line") != "") & (F.col("head") == 0)).alias("lines"), F.sum(F.when(F.col("head") == 0, F.length("line")).otherwise(0)).cast("long").alias("chars"), F.max(F.when(F.col("head") == 1, F.col("line"))).alias("title")
    )


def _fields(names) -> str:
    """One SELECT per field, of its first value in each line."""
    return " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, regexp_extract(line, '(?i){p}', 1) AS value, {c} AS confidence FROM l" for f, p, c in V.METADATA_PATTERNS if f in names)


_DISTINCT_FIELDS = "SELECT doc_id, field, min(trim(value)) AS value, max(confidence)::DOUBLE AS confidence FROM v WHERE trim(value) <> '' GROUP BY doc_id, field, lower(trim(value))"


@query(f"WITH {_LINE_SQL}, v AS ({_fields(('author', 'isbn', 'publication_year'))}) {_DISTINCT_FIELDS}")
def doc_metadata(spark, sf):
    """Author, year and ISBN by pattern, one row per distinct value."""
    found = D.metadata(table(spark, sf, "documents"), ("author", "isbn", "publication_year"))
    return found.select("doc_id", "field", "value", "confidence")


@query(f"""WITH {_LINE_SQL}, v AS ({_fields([f for f, _, _ in V.METADATA_PATTERNS])}
 UNION ALL SELECT doc_id, 'title', CASE WHEN len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) BETWEEN 2 AND 20 AND length(x) <= 180 THEN x ELSE '' END, 0.65 FROM (SELECT doc_id, min_by(line, k) AS x FROM l WHERE line <> '' GROUP BY doc_id)) {_DISTINCT_FIELDS}""")
def doc_metadata_whole(spark, sf):
    """All fields by pattern, and the title by the first line, one row per distinct value."""
    docs = table(spark, sf, "documents")
    return D.metadata(docs).select("doc_id", "field", "value", "confidence").unionByName(D.first_line_title(docs))


@query("""SELECT source, sha256(text) AS digest, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY ALL""")
def doc_exact_dedup(spark, sf):
    """Equal texts of a source are one document."""
    return table(spark, sf, "documents").groupBy("source", F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies"))


@query(f"""WITH t AS (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS k FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[A-Za-z0-9][A-Za-z0-9_-]{{1,}}'), lambda x: x NOT IN {_list(V.STOP_WORDS)}) AS w FROM benchmark)),
f AS (SELECT item_id, term, min(k) AS k FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k) AS place FROM f)
SELECT item_id, string_agg(term, ' ' ORDER BY place) AS terms FROM r WHERE place <= 24 GROUP BY item_id""")
def research_terms(spark, sf):
    """Search terms of each benchmark text, in order."""
    return table(spark, sf, "benchmark").select("item_id", F.array_join(T.research_terms(F.col("text")), " ").alias("terms")).filter("terms != ''")


@query(f"""WITH c AS (SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'They' WHEN 1 THEN 'which' WHEN 2 THEN 'videos' WHEN 3 THEN 'x' ELSE 'Order' END AS s, CASE o_orderkey % 8 WHEN 3 THEN 'click' ELSE 'be' END AS p,
 CASE o_orderkey % 8 WHEN 4 THEN 'All Rights Reserved' WHEN 5 THEN '1998' WHEN 6 THEN 'ISBN 12' ELSE 'is ' || o_orderpriority END AS t FROM orders)
SELECT id, CASE WHEN lower(s) IN {_list(V.PRONOUNS)} THEN 'pronoun-heavy' WHEN lower(s) IN {_list(V.INTERROGATIVES + V.INTERFACE_NOUNS + V.NAVIGATION_WORDS)} OR p IN {_list(V.NAVIGATION_WORDS)} THEN 'navigation'
 WHEN regexp_matches(lower(t), '{V.FOOTER_PATTERN}') THEN 'footer' WHEN regexp_matches(lower(t), '\\b(isbn|issn)\\b|^[0-9]{{4}}$') THEN 'reference' ELSE 'content' END AS kind FROM c""")
def content_kind(spark, sf):
    """What a claim's text is, over orders that are dressed as claims of each kind."""
    k = F.col("o_orderkey") % 8
    s = F.when(k == 0, "They").when(k == 1, "which").when(k == 2, "videos").when(k == 3, "x").otherwise("Order")
    t = F.when(k == 4, "All Rights Reserved").when(k == 5, "1998").when(k == 6, "ISBN 12").otherwise(F.concat(F.lit("is "), F.col("o_orderpriority")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), T.content_kind(s, F.when(k == 3, "click").otherwise("be"), t).alias("kind"))


@query(f"""WITH l AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'Someone' WHEN 1 THEN p_name || ' of' WHEN 2 THEN 'a@b' WHEN 3 THEN '  ' || p_type || '_' || p_brand ELSE p_name END AS v FROM part),
n AS (SELECT id, regexp_replace(replace(trim(v), '_', ' '), '\\s+', ' ', 'g') AS label FROM l)
SELECT id, CASE WHEN length(label) < 2 OR lower(label) IN {_list(V.UNUSABLE_LABELS)} OR contains(label, '@') OR NOT regexp_matches(label, '[A-Za-z]') OR regexp_matches(lower(label), '\\b(and|or|of|the|with|for|to|in|at|a|an)$') THEN NULL ELSE lower(label) END AS label,
 CASE WHEN length(label) < 2 OR lower(label) IN {_list(V.UNUSABLE_LABELS)} OR contains(label, '@') OR NOT regexp_matches(label, '[A-Za-z]') OR regexp_matches(lower(label), '\\b(and|or|of|the|with|for|to|in|at|a|an)$') THEN NULL ELSE 'topic-v1:' || sha256('part' || chr(31) || 'name' || chr(31) || lower(label)) END AS identity FROM n""")
def topic_labels(spark, sf):
    """Usable topic labels and their identities."""
    k = F.col("p_partkey") % 6
    v = F.when(k == 0, "Someone").when(k == 1, F.concat("p_name", F.lit(" of"))).when(k == 2, "a@b").when(k == 3, F.concat(F.lit("  "), "p_type", F.lit("_"), "p_brand")).otherwise(F.col("p_name"))
    label = T.topic_label(v)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), label.alias("label"), F.when(label.isNotNull(), T.topic_identity(F.lit("part"), F.lit("name"), v)).alias("identity"))


_SAID = {0: "I will bring {p}.", 1: "She remembers the {p}!", 2: "They want to sell {p}", 3: "You must keep {p}.", 4: "Is it {p}?", 5: "He is trapped inside {p}.", 6: "Someone took {p}.", 7: "I will not sell {p}.", 8: "I think that {p} helps.", 9: "nothing: {p}"}


@query("SELECT o_orderkey AS id, CASE o_orderkey % 10 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(("'GOAL'", "'MEMORY'", "'GOAL'", "'RULE'", "NULL", "'STATE'", "'EVENT'", "'STATE'", "'BELIEF'", "NULL"))) + " END AS kind, CASE o_orderkey % 10 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(("'I'", "'She'", "'They'", "'You'", "NULL", "'He'", "NULL", "'I'", "'I'", "NULL"))) + " END AS subject FROM orders")
def message_units(spark, sf):
    """Cognitive units of messages; the supplied turns are pseudo-words, so orders are put into ten sentences of which each kind's is known."""
    said = F.when(F.lit(False), "")
    for k, text in _SAID.items():
        said = said.when(F.col("o_orderkey") % 10 == k, F.concat(F.lit(text.split("{p}")[0]), F.regexp_replace("o_orderpriority", "[^A-Z]", ""), F.lit(text.split("{p}")[1])))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), T.message_unit(said).alias("u")).select("id", "u.kind", "u.subject")


@query()
def message_units_turns(spark, sf):
    """Cognitive units of every real turn; the patterns are not for SQL, small tests hold them."""
    return table(spark, sf, "conversations").select("conv_id", "turn", T.message_unit(F.col("text")).alias("u")).select("conv_id", "turn", "u.kind", "u.subject")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'SPATIAL' WHEN 1 THEN 'SOCIAL' WHEN 2 THEN 'DESCRIPTIVE' ELSE 'RULE' END AS family, CASE o_orderkey % 4 WHEN 0 THEN 'STATE' WHEN 1 THEN 'RELATIONSHIP' WHEN 2 THEN 'STATE' ELSE 'RULE' END AS kind FROM orders""")
def predicate_families(spark, sf):
    """Family and kind of predicates: the first list that has one decides, then words of the text."""
    k = F.col("o_orderkey") % 4
    family = T.predicate_family(F.when(k == 0, "Located At").when(k == 1, "knows").when(k == 2, "state").otherwise("zz"), F.when(k == 3, "it is forbidden").otherwise(""))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), family.alias("family"), T.claim_kind(family).alias("kind"))


@query(r"""SELECT page_id, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang, len(regexp_extract_all(html, '<a href="')) AS links FROM pages""")
def page_links(spark, sf):
    """Language and number of link references of each page, from its parsed HTML."""
    return H.extract(table(spark, sf, "pages")).select("page_id", "lang", F.size("hrefs").cast("long").alias("links"))


@query(r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'ao3' WHEN 1 THEN 'structured-metadata' ELSE 'generic-web' END AS adapter, CASE WHEN page_id % 3 = 0 THEN 'fanwork' END AS namespace,
 CASE page_id % 3 WHEN 0 THEN 'repository=ao3,source_type=fanfiction,canon_status=fanwork,fandom=f' || page_id || ' & co,character=ann,character=bob,tag=quiet' WHEN 1 THEN 'subject=topic ' || page_id || ',subject=two,subject=named,subject=meta,source_type=article,source_type=thing' ELSE 'repository=www.h.org' END AS facets FROM pages""")
def page_facets(spark, sf):
    """What pages are about, by adapters of sources; the supplied pages have no metadata, so theirs are put before them."""
    n, i = F.col("page_id") % 3, F.col("page_id").cast("string")
    work = F.concat(F.lit('<dl><dd class="fandom tags"><a class="tag">F'), i, F.lit(' &amp; Co</a></dd><dd class="character tags"><a class="tag">Ann</a><a class="tag">Bob</a><a class="tag">Ann</a><a>no</a></dd><dd class="freeform tags"><a class="tag"> Quiet </a></dd></dl>'))
    data = F.concat(F.lit('<meta name="dc.subject" content="Meta"><script type="application/ld+json">{"@graph": [{"@type": ["Article", "Thing"], "about": [{"name": "Topic '), i, F.lit('"}, "Two"], "keywords": "Named, Two", "articleBody": {"about": "no"}}]}</script><script type="application/ld+json">{no</script>'))
    url = F.when(n == 0, F.concat(F.lit("https://archiveofourown.org/works/"), i)).when(n == 1, "https://h.org/x").otherwise("https://WWW.h.org/y")
    pages = table(spark, sf, "pages").select("page_id", url.alias("url"), F.concat(F.when(n == 0, work).when(n == 1, data).otherwise(""), "html").alias("html"))
    lists = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    own = F.map_from_entries(F.array(F.struct(F.lit("schema_org"), F.map_from_entries(F.array(lists("subjects", F.col("subjects")), lists("source_type", F.col("source_types")))))))
    some = F.when((F.size("subjects") > 0) | (F.size("source_types") > 0), own).otherwise(F.create_map().cast("map<string,map<string,array<string>>>"))
    found = H.extract(pages).join(pages.select("page_id", "url"), "page_id").select("page_id", H.facets(F.regexp_extract("url", "://([^/]*)", 1), F.col("work_tags"), some).alias("f"))
    return found.select("page_id", "f.adapter", "f.namespace", F.array_join(F.transform("f.facets", lambda x: F.concat_ws("=", x["kind"], x["value"])), ",").alias("facets"))


_CLAUSES = {0: "If only it were {p}", 1: "Suppose that {p} wins", 2: "Provided that {p} holds, go", 3: "Is it {p}?”  ", 4: "It is {p}", 5: "I wish for {p}!", 6: "  assuming that {p}", 7: "Let’s say {p}"}


@query("SELECT o_orderkey AS id, CASE o_orderkey % 8 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(("counterfactual", "hypothetical", "conditional", "question", "asserted", "counterfactual", "hypothetical", "hypothetical"))) + " END AS scope, CASE o_orderkey % 8 WHEN 4 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'conditional' ELSE 'asserted' END " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(("counterfactual", "hypothetical", "conditional", "question", "asserted", "counterfactual", "hypothetical", "hypothetical")) if k != 4) + " END AS effective FROM orders")
def clause_scopes(spark, sf):
    """Scope of clauses, and within a conditional one; orders are put into eight clauses whose scopes are known."""
    k = F.col("o_orderkey") % 8
    said = F.coalesce(*[F.when(k == j, F.replace(F.lit(t), F.lit("{p}"), F.col("o_orderpriority"))) for j, t in _CLAUSES.items()])
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), T.clause_scope(said).alias("scope"), T.effective_scope(said, F.when(F.col("o_orderkey") % 3 == 0, "conditional")).alias("effective"))


@query()
def page_text(spark, sf):
    """Cleaned text, title and estimate of tokens of each page: parsing, not SQL; tests hold it against small pages."""
    found = H.extract(table(spark, sf, "pages"))
    return found.select("page_id", "title", F.sha2("text", 256).alias("digest"), F.length("text").alias("chars"), (F.length("text") / 4).cast("int").alias("tokens"), F.size(F.filter(F.split("text", "\n"), lambda x: F.length(x) > 80)).alias("paragraphs"))


@query("""WITH d AS (SELECT page_id AS doc_id, 's' || (page_id % 5) AS source, CASE page_id % 6 WHEN 0 THEN 'https://www.Wiki.org/en/' || page_id WHEN 1 THEN 'wiki.org/' || page_id WHEN 2 THEN 'https://a.wiki.org/en' WHEN 3 THEN 'http://u@news.net:80/x?q=/en/' WHEN 4 THEN NULL ELSE 'http://other.net/english' END AS uri FROM pages),
h AS (SELECT *, lower(regexp_extract(CASE WHEN contains(uri, '://') THEN uri ELSE 'https://' || uri END, '^[^:]*://(?:[^/?#]*@)?([^/?#:]*)', 1)) AS host, regexp_extract(CASE WHEN contains(uri, '://') THEN uri ELSE 'https://' || uri END, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path FROM d),
p(profile, source, pattern, start, priority) AS (VALUES ('english', NULL, '.wiki.org', '/en', 5), ('wiki', 's1', 'wiki.org', NULL, 5), ('news', NULL, 'news.net', NULL, 1), ('three', 's3', NULL, NULL, 1), ('top', 's4', NULL, '/en', 9)),
m AS (SELECT doc_id, profile, matched, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, spec DESC) AS k FROM (SELECT doc_id, profile, priority, CASE WHEN p.source = h.source THEN 2 ELSE 1 END AS spec, CASE WHEN p.source = h.source THEN 'source_id' ELSE 'domain' END AS matched FROM h JOIN p ON (p.source = h.source OR CASE WHEN starts_with(pattern, '.') THEN ends_with(host, pattern) AND host <> substr(pattern, 2) ELSE host = pattern END) AND (start IS NULL OR path = start OR starts_with(path, start || '/'))))
SELECT d.doc_id, coalesce(profile, 'inbox') AS profile, coalesce(matched, 'fallback') AS matched FROM d LEFT JOIN m ON m.doc_id = d.doc_id AND k = 1""")
def source_routing(spark, sf):
    """Profile of a page by its source, host and path: priority first, then what is more specific, else the inbox."""
    k = F.col("page_id")
    n = k.cast("string")
    uri = F.when(k % 6 == 0, F.concat(F.lit("https://www.Wiki.org/en/"), n)).when(k % 6 == 1, F.concat(F.lit("wiki.org/"), n)).when(k % 6 == 2, "https://a.wiki.org/en").when(k % 6 == 3, "http://u@news.net:80/x?q=/en/").when(k % 6 == 5, "http://other.net/english")
    pages = table(spark, sf, "pages").select(k.alias("doc_id"), F.concat(F.lit("s"), (k % 5).cast("string")).alias("source"), uri.alias("uri"))
    return D.route(pages, [D.Profile("english", hosts="*.wiki.org", path="en", priority=5), D.Profile("wiki", "s1", "wiki.org.", priority=5), D.Profile("news", hosts="News.net", priority=1), D.Profile("three", "s3", priority=1), D.Profile("top", "s4", path="/en", priority=9)])


@query(f"""WITH f AS (SELECT DISTINCT doc_id, 's' || (doc_id % 3) AS ns, source FROM documents), m AS (SELECT doc_id, ns FROM f WHERE source IN ('src1', 'src2', 'src3') UNION ALL SELECT doc_id, 'extra' FROM f WHERE source = 'src3')
SELECT doc_id, CASE WHEN count(DISTINCT ns) = 1 THEN min(ns) ELSE 'crossover' END AS domain FROM m GROUP BY doc_id""")
def facet_routing(spark, sf):
    """Domain of a document by the namespaces that its facets match: one wins, several are a crossover."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("ns"))
    known = d.filter(F.col("source").isin("src1", "src2", "src3"))
    facets = known.select("doc_id", "ns").unionByName(known.filter("source = 'src3'").select("doc_id", F.lit("extra").alias("ns")))
    return facets.groupBy("doc_id").agg(F.when(F.count_distinct("ns") == 1, F.min("ns")).otherwise("crossover").alias("domain"))


@query("""SELECT CAST(d AS VARCHAR) AS digest, n FROM (SELECT sha256(text) AS d, count(DISTINCT source) AS n FROM documents GROUP BY 1) WHERE n > 1""")
def cross_source_copies(spark, sf):
    """Texts that several sources share."""
    found = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count_distinct("source").alias("n"))
    return found.filter("n > 1")


@query("""WITH t AS (SELECT source AS domain, lang AS section, doc_id AS document, 't' || unnest([doc_id % 4, (doc_id + 1) % 4]) AS topic, 0.78 + (doc_id % 20) / 100.0 AS similarity, 'f' || doc_id || ':' || doc_id % 3 AS mark FROM documents),
o AS (SELECT domain, section, document, topic, max(similarity) AS similarity, max(mark) AS mark FROM t GROUP BY ALL),
p AS (SELECT a.domain, a.topic AS a, b.topic AS b, a.document, a.section, a.mark, least(a.similarity, b.similarity) AS s FROM o a JOIN o b ON a.domain = b.domain AND a.section = b.section AND a.document = b.document AND a.topic < b.topic WHERE least(a.similarity, b.similarity) >= 0.78)
SELECT domain, a, b, count(DISTINCT document) AS documents, count(DISTINCT section) AS sections, round(min(s), 4)::DOUBLE AS signal, sha256('[' || string_agg('["' || section || '","' || mark || '"]', ',' ORDER BY section, mark) || ']') AS revision FROM p GROUP BY ALL HAVING count(DISTINCT document) >= 2""")
def gap_pairs(spark, sf):
    """Topics that occur together in sections of at least two documents of a domain, and the revision of what they were found in."""
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    t = d.select(F.col("source").alias("domain"), F.col("lang").alias("section"), k.alias("document"), F.explode(F.array(k % 4, (k + 1) % 4)).alias("t"), (0.78 + (k % 20) / 100.0).alias("similarity"), F.concat(F.lit("f"), k.cast("string")).alias("fingerprint"), (k % 3).alias("reference"))
    return D.gap_pairs(t.withColumn("topic", F.concat(F.lit("t"), F.col("t").cast("string"))))


@query(r"""WITH l AS (SELECT doc_id, length(text) AS whole, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM (SELECT doc_id, regexp_replace(text, '[.] ', '.' || chr(10) || chr(10), 'g') AS text FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'Chapter 1' || chr(10) || text FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 3 = 2)),
h AS (SELECT *, trim(raw) AS line, trim(raw) <> '' AND length(trim(raw)) <= 120 AND regexp_matches(trim(raw), '(?i)""" + V.HEADING_PATTERN + r"""') AS head FROM l),
s AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY k) AS section, sum((head OR line = '')::INT) OVER (PARTITION BY doc_id ORDER BY k) AS block FROM h),
e AS (SELECT doc_id, block - 1 AS block, start AS ends FROM s WHERE head OR line = ''),
p AS (SELECT s.doc_id, s.section, s.block, string_agg(line, ' ' ORDER BY k) AS content, coalesce(min(e.ends), max(whole)) AS ends FROM s LEFT JOIN e ON e.doc_id = s.doc_id AND e.block = s.block WHERE NOT head AND line <> '' GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS place FROM p)
SELECT doc_id, CASE WHEN section > 0 THEN '/section/' || (section - 1)::INT ELSE '' END || '/paragraph/' || place AS path, (section > 0)::INT AS depth, sha256(content) AS digest, greatest(0, ends - length(content))::BIGINT AS start, ends::BIGINT AS "end" FROM n
UNION ALL SELECT doc_id, '/section/' || (section - 1)::INT, 0, sha256(line), start::BIGINT, (start + length(raw) + 1)::BIGINT FROM s WHERE head""")
def doc_units(spark, sf):
    """Sections and paragraphs of documents with paths, depths and places; some are dressed with blank lines and headings."""
    k = F.col("doc_id")
    text = F.when(k % 3 == 0, F.regexp_replace("text", "[.] ", ".\n\n")).when(k % 3 == 1, F.concat(F.lit("Chapter 1\n"), F.col("text"))).otherwise(F.col("text"))
    u = D.units(table(spark, sf, "documents").select("doc_id", text.alias("text")))
    long = lambda n: F.col(n).cast("long").alias(n)
    return u.select("doc_id", "path", "depth", F.sha2(F.when(F.col("kind") == "section", F.col("title")).otherwise(F.col("content")), 256).alias("digest"), long("start"), long("end"))
