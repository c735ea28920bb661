"""Registered queries of scalar functions over texts, URLs and names."""

from pyspark.sql import functions as F

from isopleth.functions import catalog, texts
from isopleth.operators import collection
from isopleth.plans.registry import register
from isopleth.plans.tables import CHUNKS, chunk_stats8


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(pairs, test, other="NULL"):
    return "CASE " + " ".join(f"WHEN {test(a)} THEN '{b}'" for a, b in pairs) + f" ELSE {other} END"


def _any(text, parts):
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in parts) + ")"


URL = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


@register("url_format", f"""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '/data_file.nc?x=1' WHEN 1 THEN url WHEN 2 THEN 'https://z.org/files/30days.zip/content' ELSE 'https://z.org/a/b.tar.gz#frag' END AS url FROM pages),
p AS (SELECT page_id, lower({URL}) AS path FROM u), s AS (SELECT page_id, path, list_filter(list_transform(list_reverse(string_split(path, '/')), lambda x: {_case(texts.FORMATS.items(), lambda a: f"regexp_extract(x, '[^.](\\.[^.]+)$', 1) = '{a}'")}), lambda x: x IS NOT NULL) AS f FROM p)
SELECT page_id, CASE WHEN regexp_matches(path, '\\.(nc|tar)\\.gz$') THEN 'gz' ELSE coalesce(f[1], 'unknown') END AS format FROM s""")
def url_format(spark, sf_dir):
    """The format that a URL names."""
    n = F.col("page_id") % 4
    url = F.when(n == 0, F.concat("url", F.lit("/data_file.nc?x=1"))).when(n == 1, F.col("url")).when(n == 2, "https://z.org/files/30days.zip/content").otherwise("https://z.org/a/b.tar.gz#frag")
    return _read(spark, sf_dir, "pages").select("page_id", texts.url_format(url).alias("format"))


@register("url_name", f"""WITH p AS (SELECT page_id, list_filter(string_split({URL}, '/'), lambda x: x <> '')[-1] AS last FROM pages), w AS (SELECT page_id, string_split(trim(regexp_replace(regexp_replace(last, '\\.[A-Za-z0-9]+$', ''), '[-_.]+', ' ', 'g')), ' ') AS words FROM p)
SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, array_to_string(list_transform(words, lambda x: upper(left(x, 1)) || lower(substr(x, 2))), ' ') AS name FROM w JOIN pages USING (page_id)""")
def url_name(spark, sf_dir):
    """X11: a title from a URL's last segment."""
    return _read(spark, sf_dir, "pages").select("page_id", texts.url_host(F.col("url")).alias("host"), texts.dataset_name(F.col("url")).alias("name"))


@register("portal_suffix", f"""WITH h AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'data.psl.noaa.gov' WHEN 1 THEN 'ecmwf.int' ELSE lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) END AS host FROM pages)
SELECT page_id, host, {_case(catalog.PORTALS, lambda d: f"host = '{d}' OR ends_with(host, '.{d}')")} AS portal FROM h""")
def portal_suffix(spark, sf_dir):
    """The portal of a host by domain suffix."""
    n = F.col("page_id") % 3
    url = F.when(n == 0, "https://data.psl.noaa.gov/x").when(n == 1, "http://ecmwf.int").otherwise(F.col("url"))
    return _read(spark, sf_dir, "pages").select("page_id", texts.url_host(url).alias("host"), catalog.portal(url).alias("portal"))


@register("slugify", "SELECT DISTINCT p_name, rtrim(left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_'), 60), '_') AS slug, regexp_matches(p_name, '^[A-Za-z][A-Za-z0-9_]{0,59}$') AS sane FROM part")
def slugify(spark, sf_dir):
    """Slugs and whether a name is a variable's."""
    return _read(spark, sf_dir, "part").select("p_name", texts.slugify(F.col("p_name")).alias("slug"), texts.is_variable_name(F.col("p_name")).alias("sane")).distinct()


@register("topics", "SELECT conv_id, turn, list_filter([" + ", ".join(f"CASE WHEN {_any('lower(text)', parts)} THEN '{name}' END" for name, parts in texts.TOPICS) + "], lambda x: x IS NOT NULL) AS topics FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text || ' Drought and RAIN' WHEN 1 THEN text ELSE 'sea-level ' || text END AS text FROM conversations)")
def topics(spark, sf_dir):
    """Topics of each turn."""
    n = F.col("turn") % 3
    text = F.when(n == 0, F.concat("text", F.lit(" Drought and RAIN"))).when(n == 1, F.col("text")).otherwise(F.concat(F.lit("sea-level "), "text"))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", texts.topics(text).alias("topics"))


@register("question_type", f"SELECT conv_id, turn, {_case([(p, n) for n, p in texts.QUESTION_TYPES], lambda p: _any('lower(text)', p), chr(39) + 'general' + chr(39))} AS kind FROM conversations")
def question_type(spark, sf_dir):
    """The type of each turn's question."""
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", texts.question_type(F.col("text")).alias("kind"))


@register("extract_years", r"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'from 1990 to 2005, ' ELSE '' END || text AS text FROM documents), x AS (SELECT doc_id, regexp_extract(text, '(?i)\b((?:19|20)\d\d)\s*(?:-|to|do)\s*((?:19|20)\d\d)\b', ['a', 'b']) AS r, list_transform(regexp_extract_all(text, '\b((?:19|20)\d\d)\b', 1), lambda y: CAST(y AS INTEGER)) AS every FROM t)
SELECT doc_id, coalesce(CAST(nullif(least(r.a, r.b), '') AS INTEGER), list_min(every)) AS first, coalesce(CAST(nullif(greatest(r.a, r.b), '') AS INTEGER), list_max(every)) AS last FROM x""")
def extract_years(spark, sf_dir):
    """The years that a text names."""
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, "from 1990 to 2005, ").otherwise(""), "text")
    return _read(spark, sf_dir, "documents").select("doc_id", texts.years(text).alias("y")).select("doc_id", "y.first", "y.last")


@register("phase_classifier", f"""WITH e AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'ERA5' WHEN 1 THEN 'MSWEP' WHEN 2 THEN 'IMERG' ELSE 'set' || page_id END AS name, CASE page_id % 4 WHEN 0 THEN 'Open' WHEN 1 THEN 'Upon registration' WHEN 2 THEN 'contact us' ELSE NULL END AS access,
 CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN url || '/x.nc' WHEN 2 THEN 'https://psl.noaa.gov/d' WHEN 3 THEN 'ask us' ELSE url END AS link FROM pages),
 n AS (SELECT page_id, name, lower(trim(coalesce(access, ''))) AS access, trim(coalesce(link, '')) AS url FROM e), h AS (SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, lower({URL}) AS path FROM n)
SELECT page_id, CAST(CASE WHEN name = 'ERA5' THEN 3 WHEN name = 'MSWEP' THEN 4 WHEN name = 'IMERG' THEN 3 WHEN NOT regexp_matches(url, '^https?://') OR contains(url, ' or ') OR contains(access, 'contact') THEN 4
 WHEN {_case(catalog.PORTALS, lambda d: f"host = '{d}' OR ends_with(host, '.{d}')")} IS NOT NULL THEN 3 WHEN regexp_matches(path, '{catalog.DIRECT_SUFFIXES}') AND NOT contains(access, 'registration') THEN 1 WHEN contains(access, 'registration') THEN 2 WHEN access = 'open' THEN 1 ELSE 4 END AS INTEGER) AS phase FROM h""")
def phase_classifier(spark, sf_dir):
    """the phase of each entry."""
    n = lambda k: F.col("page_id") % k
    name = F.when(n(6) == 0, "ERA5").when(n(6) == 1, "MSWEP").when(n(6) == 2, "IMERG").otherwise(F.concat(F.lit("set"), "page_id"))
    access = F.when(n(4) == 0, "Open").when(n(4) == 1, "Upon registration").when(n(4) == 2, "contact us")
    link = F.when(n(5) == 1, F.concat("url", F.lit("/x.nc"))).when(n(5) == 2, "https://psl.noaa.gov/d").when(n(5) == 3, "ask us").when(n(5) == 4, F.col("url"))
    return _read(spark, sf_dir, "pages").select("page_id", catalog.phase(name, access, link).alias("phase"))


@register("bbox_zone", f"""WITH b AS (SELECT event_id, (user_id * 7) % 160 - 80 AS south, (event_id * 13) % 340 - 170 AS west, (event_id % 5) * 40 AS size FROM events), c AS (SELECT event_id, south, west, size, south + size / 2.0 AS lat, west + size AS lon FROM b)
SELECT event_id, CASE WHEN size > 150 AND size * 2 > 300 THEN 'Global' ELSE coalesce({_case([(z[:4], z[4]) for z in catalog.ZONES], lambda z: f"lat BETWEEN {z[0]} AND {z[1]} AND lon BETWEEN {z[2]} AND {z[3]}")}, 'Global') END AS zone FROM c""")
def bbox_zone(spark, sf_dir):
    """The zone of a box's centre."""
    south, west, size = (F.col("user_id") * 7) % 160 - 80, (F.col("event_id") * 13) % 340 - 170, (F.col("event_id") % 5) * 40
    return _read(spark, sf_dir, "events").select("event_id", catalog.zone(south, south + size, west, west + 2 * size).alias("zone"))


@register("region_inference", "SELECT doc_id, " + _case(catalog.REGIONS, lambda p: f"contains(lower(name), '{p}')") + " AS region FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'E-OBS ' || source WHEN 1 THEN 'CHIRPS v2' WHEN 2 THEN 'MED-CORDEX' ELSE source END AS name FROM documents)")
def region_inference(spark, sf_dir):
    """The region that a dataset's name tells."""
    n = F.col("doc_id") % 4
    name = F.when(n == 0, F.concat(F.lit("E-OBS "), "source")).when(n == 1, "CHIRPS v2").when(n == 2, "MED-CORDEX").otherwise(F.col("source"))
    return _read(spark, sf_dir, "documents").select("doc_id", catalog.region(name).alias("region"))


@register("chunk_text", f"""WITH {CHUNKS} SELECT variable, day, 'events - ' || variable || ' in EUR. Climate hazard context: web traffic. Period: ' || day || ' to ' || day || ' (1 days). Statistics: mean ' || CAST(CAST(round(mean, 2) AS DECIMAL(18, 2)) AS VARCHAR) || ', range ' || CAST(CAST(round(min, 2) AS DECIMAL(18, 2)) AS VARCHAR) || ' to ' || CAST(CAST(round(max, 2) AS DECIMAL(18, 2)) AS VARCHAR) AS text FROM chunks""")
def chunk_text(spark, sf_dir):
    """Each chunk's description."""
    day = F.col("day")
    rounded = lambda c: F.round(c, 2)
    text = texts.chunk_text(F.lit("events"), F.col("variable"), F.lit("EUR"), F.lit("catalog_web_traffic"), day, day, rounded("mean"), rounded("min"), rounded("max"))
    return chunk_stats8(spark, sf_dir).select("variable", "day", text.alias("text"))


@register("catalog_ids", "SELECT p_partkey, 'catalog_' || replace(replace(replace(replace(p_name, ' ', '_'), '/', '-'), '(', ''), ')', '') || '_' || p_partkey AS source_id, 'catalog_' || lower(replace(coalesce(p_type, 'general'), ' ', '_')) AS variable FROM part")
def catalog_ids(spark, sf_dir):
    """Ids and variables of catalog entries."""
    return _read(spark, sf_dir, "part").select("p_partkey", texts.source_id(F.col("p_name"), F.col("p_partkey")).alias("source_id"), texts.catalog_variable(F.col("p_type")).alias("variable"))


@register("point_ids", """WITH h AS (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)
SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || printf('%02x', (CAST('0x' || substr(h, 17, 2) AS INTEGER) & 63) | 128) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS id FROM h""")
def point_ids(spark, sf_dir):
    """Name-based UUIDs of all pages."""
    return _read(spark, sf_dir, "pages").select("page_id", collection.uuid5(F.col("url")).alias("id"))
