"""Registered queries over search, import, playlists and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from stave.functions import scalars as S
from stave.functions import text as X
from stave.functions import vocabulary as V
from stave.operators import catalog as K
from stave.operators import selection as G
from stave.plans.chord_queries import compact, in_sql, r6
from stave.plans.registry import query, sql_case, view
from stave.sinks import documents as D
from stave.sources import imports as I
from stave.sources import search as SR


def tokens_sql(expr: str) -> str:
    return (
        f"list_filter(list_transform(string_split_regex(regexp_replace(lower({expr}), '[''’‘ʼ]', '', 'g'), '[^\\p{{L}}\\p{{N}}]+'), "
        f"lambda z: left(z, 64)), lambda z: z <> '' AND z NOT IN {tuple(V.TITLE_STOP_TOKENS)})[1:32]"
    )


def similarity_sql(a: str, b: str) -> str:
    longest = f"greatest(length({a}), length({b}))"
    near = f"(1e0 - levenshtein({a}, {b})::DOUBLE / {longest})"
    return f"CASE WHEN {a} = {b} THEN 1e0 WHEN {longest} < 4 THEN 0e0 WHEN {near} >= 72e-2 THEN {near} ELSE 0e0 END"


def recall_sql(e: str, a: str) -> str:
    best = f"coalesce(list_max(list_transform({a}, lambda y: {similarity_sql('x', 'y')})), 0e0)"
    return f"CASE WHEN coalesce(len({e}), 0) = 0 THEN 0e0 ELSE list_sum(list_transform({e}, lambda x: {best})) / len({e}) END"


_MARK = " + ".join(f"(NOT list_contains(q, '{m}') AND list_contains(t, '{m}'))::INT" for m in V.VERSION_MARKERS)
_META = """(verified::INT * 3e-2 + (contains(lower(channel), 'official') OR contains(lower(channel), 'vevo') OR contains(lower(channel), 'topic'))::INT * 5e-3
  + coalesce(greatest(0, least(1, log10(views + 1e0) / 9e0)), 0) * 1e-2 + greatest(0, 1 - search_index / 10e0) * 5e-3)"""
view("v_tokens", f"""
SELECT *, {tokens_sql('query')} AS q, {tokens_sql('title')} AS t, {tokens_sql('channel')} AS c, contains(query, ' - ') AS structured,
  {tokens_sql("split_part(query, ' - ', 1)")} AS a, {tokens_sql("split_part(query, ' - ', 2)")} AS w FROM v_candidates""")
view("v_scored", f"""
SELECT query_id, query, search_index, id, title, channel, t, greatest(1e-2, least(99e-2, CASE WHEN structured
  THEN 42e-2 * {recall_sql('w', 't')} + 24e-2 * greatest({recall_sql('a', 't')}, {recall_sql('a', 'c')}) + 17e-2 * {recall_sql('q', 't')}
    + 7e-2 * {recall_sql('q', 'list_concat(t, c)')} + 5e-2 * {recall_sql('t', 'q')} + {_META}
  ELSE 58e-2 * {recall_sql('q', 't')} + 24e-2 * {recall_sql('t', 'q')} + 10e-2 * {recall_sql('q', 'list_concat(t, c)')} + 3e-2 * {recall_sql('q', 'c')} + {_META} END
  - least(36e-2, ({_MARK}) * 12e-2))) AS score FROM v_tokens""")


def scored(t):
    return K.relevance_score(SR.scan_search_results(t.search_rows))


@query("scan_search_results", """
SELECT query_id, search_index, id, trim(title) AS title, channel, views, verified, 'https://www.youtube.com/watch?v=' || id AS source_url FROM v_candidates""")
def scan_search_results(t):
    return SR.scan_search_results(t.search_rows).select("query_id", "search_index", "id", "title", "channel", "views", "verified", "source_url")


@query("relevance_score", "SELECT query_id, search_index, round(score, 6) AS score FROM v_scored")
def relevance_score(t):
    return scored(t).select("query_id", "search_index", r6("score"))


@query("top5_results", """
SELECT query_id, search_index, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, search_index)::INT AS rank
FROM (SELECT * FROM v_scored QUALIFY row_number() OVER (PARTITION BY query_id, array_to_string(t, ' ') ORDER BY round(score, 9) DESC, search_index) = 1)
QUALIFY rank <= 5""")
def top5_results(t):
    return K.top_results(scored(t).withColumn("score", F.round("score", 9))).select("query_id", "search_index", "rank")


@query("title_tokens", f"""
SELECT 'part' AS kind, p_partkey AS title_id, array_to_string({tokens_sql('p_name')}, ' ') AS tokens FROM part
UNION ALL SELECT 'search', query_id * 1000 + search_index, array_to_string(t, ' ') FROM v_tokens""")
def title_tokens(t):
    parts = t.source("part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("title_id"), F.col("p_name").alias("title"))
    found = SR.scan_search_results(t.search_rows).select(F.lit("search").alias("kind"), (F.col("query_id") * 1000 + F.col("search_index")).alias("title_id"), "title")
    return parts.unionByName(found).select("kind", "title_id", F.array_join(X.tokens(F.col("title")), " ").alias("tokens"))


view("v_pairs", "SELECT query_id, search_index, q, t, b, unnest(q) AS a FROM (SELECT *, unnest(t) AS b FROM v_tokens)")


@query("token_similarity", f"SELECT DISTINCT a, b, round({similarity_sql('a', 'b')}, 6) AS similarity FROM v_pairs")
def token_similarity(t):
    rows = SR.scan_search_results(t.search_rows)
    pairs = rows.select(F.explode(X.tokens(F.col("query"))).alias("a"), "title").select("a", F.explode(X.tokens(F.col("title"))).alias("b")).distinct()
    return pairs.select("a", "b", F.round(X.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("sql_token_similarity", same_as="token_similarity")
def sql_token_similarity(t):
    return in_sql(t, SR.scan_search_results(t.search_rows), """
SELECT a, b, round(token_similarity(a, b), 6) AS similarity FROM (
  SELECT DISTINCT a, b FROM (SELECT title_tokens(query) AS q, title_tokens(title) AS t FROM {rows}) LATERAL VIEW explode(q) x AS a LATERAL VIEW explode(t) y AS b)""")


@query("token_recall", f"SELECT query_id, search_index, round({recall_sql('q', 't')}, 6) AS recall, round({recall_sql('t', 'q')}, 6) AS precision FROM v_tokens")
def token_recall(t):
    rows = SR.scan_search_results(t.search_rows).select("query_id", "search_index", X.tokens(F.col("query")).alias("q"), X.tokens(F.col("title")).alias("t"))
    return rows.select(
        "query_id", "search_index", F.round(X.recall(F.col("q"), F.col("t")), 6).alias("recall"), F.round(X.recall(F.col("t"), F.col("q")), 6).alias("precision"))


@query("lyrics_queries", """
SELECT query_id, search_index, pass::INT AS pass, array_to_string(ws[1:len(ws) - pass], ' ') AS lyrics_query
FROM (SELECT query_id, search_index, list_filter(string_split(trim(regexp_replace(regexp_replace(title, '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '') AS ws
  FROM v_candidates), range(3) p(pass) WHERE len(ws) > pass""")
def lyrics_queries(t):
    rows = SR.scan_search_results(t.search_rows).withColumn("plain", X.nfkc("title"))
    return rows.select("query_id", "search_index", F.posexplode(X.lyrics_queries(F.col("plain"))).alias("pass", "lyrics_query"))


@query("preferred_lyrics", """
SELECT query_id, id, seq, duration_s FROM v_lyric_results WHERE NOT instrumental AND (has_synced OR has_plain)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY has_synced DESC, coalesce(abs(duration_s - audio_s), 0), seq) = 1""")
def preferred_lyrics(t):
    return K.preferred_lyrics(t.lyric_results).select("query_id", "id", F.col("seq").cast("bigint").alias("seq"), "duration_s")


@query("duration_relevance", """
SELECT query_id, seq, CASE WHEN audio_s IS NULL OR duration_s <= 0 THEN 0 WHEN d <= 2 OR d / audio_s <= 15e-3 THEN 4 WHEN d <= 8 OR d / audio_s <= 5e-2 THEN 3
  WHEN d <= 15 OR d / audio_s <= 1e-1 THEN 2 WHEN d / audio_s <= 2e-1 THEN 1 ELSE 0 END AS level FROM (SELECT *, abs(duration_s - audio_s) AS d FROM v_lyric_results)""")
def duration_relevance(t):
    return t.lyric_results.select("query_id", F.col("seq").cast("bigint").alias("seq"), S.duration_level(F.col("duration_s"), F.col("audio_s")).alias("level"))


@query("relevance_bands", """
SELECT query_id, search_index, pct::INT AS percent, CASE WHEN pct >= 100 THEN 4 WHEN pct >= 75 THEN 3 WHEN pct >= 50 THEN 2 WHEN pct >= 25 THEN 1 ELSE 0 END AS level
FROM (SELECT query_id, search_index, floor(greatest(0, least(1, round(score, 9))) * 100 + 5e-1) AS pct FROM v_scored)""")
def relevance_bands(t):
    rows = scored(t).withColumn("percent", S.relevance_percent(F.round("score", 9)))
    return rows.select("query_id", "search_index", "percent", S.level_of_percent(F.col("percent")).alias("level"))


_HOST = "lower(regexp_extract(regexp_replace(regexp_extract(regexp_replace({0}, '^.*?://', ''), '^([^/?#]*)', 1), '^.*@', ''), '^([^:]*)', 1))"


def host_sql(expr: str) -> str:
    return _HOST.format(expr)


def provider_sql(expr: str) -> str:
    h = host_sql(expr)
    arms = " ".join(
        f"WHEN {h} = '{s}'" + ("" if s in V.EXACT_HOSTS else f" OR {h} LIKE '%.{s}'") + f" THEN '{n}'" for s, n in V.PROVIDERS.items())
    return f"CASE {arms} ELSE 'Web' END"


view("v_urls", """
SELECT page_id, k, CASE k WHEN 0 THEN url WHEN 1 THEN replace(url, '.example.com', '.bandcamp.com') WHEN 2 THEN 'https://user@www.youtube.com:443/watch?v=' || page_id || '&list=' || (page_id // 3)
  ELSE 'https://youtu.be/' || page_id || '?t=1' END AS url FROM pages, range(4) g(k)""")


def urls(t):
    base = t.source("pages").select("page_id", "url", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(4)])).alias("k"))
    pid = F.col("page_id").cast("string")
    made = (
        F.when(F.col("k") == 0, F.col("url")).when(F.col("k") == 1, F.replace("url", F.lit(".example.com"), F.lit(".bandcamp.com")))
        .when(F.col("k") == 2, F.concat(F.lit("https://user@www.youtube.com:443/watch?v="), pid, F.lit("&list="), F.floor(F.col("page_id") / 3).cast("string")))
        .otherwise(F.concat(F.lit("https://youtu.be/"), pid, F.lit("?t=1")))
    )
    return base.select("page_id", "k", made.alias("url"))


@query("provider_of_url", f"SELECT page_id, k, url, {provider_sql('url')} AS provider FROM v_urls")
def provider_of_url(t):
    return urls(t).withColumn("provider", X.provider_of(F.col("url")))


_U = r"'^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$'"


def url_key_sql(u: str) -> str:
    part = lambda n: f"regexp_extract({u}, {_U}, {n})"
    param = lambda n: f"regexp_extract({part(4)}, '[?&]{n}=([^&]*)', 1)"
    path = f"regexp_replace({part(3)}, '/$', '')"
    auth = f"CASE lower({part(1)}) WHEN 'https' THEN regexp_replace(lower({part(2)}), ':443$', '') WHEN 'http' THEN regexp_replace(lower({part(2)}), ':80$', '') ELSE lower({part(2)}) END"
    return f"""CASE WHEN NOT regexp_matches({u}, {_U}) THEN 'url:' || trim({u})
      WHEN {host_sql(u)} = 'youtu.be' THEN 'youtube-video:' || regexp_extract({part(3)}, '^/*([^/]*)', 1)
      WHEN {host_sql(u)} IN {tuple(V.VIDEO_HOSTS)} AND {param('list')} <> '' THEN 'youtube-playlist:' || {param('list')}
      WHEN {host_sql(u)} IN {tuple(V.VIDEO_HOSTS)} AND {param('v')} <> '' THEN 'youtube-video:' || {param('v')}
      ELSE 'url:' || lower({part(1)}) || '://' || {auth} || CASE {path} WHEN '' THEN '/' ELSE {path} END || {part(4)} END"""


@query("candidate_key", f"SELECT page_id, k, {url_key_sql('url')} AS candidate_key FROM v_urls")
def candidate_key(t):
    return urls(t).select("page_id", "k", X.candidate_key(F.lit("video"), F.col("url")).alias("candidate_key"))


_WS = r"[\s\x{00A0}\x{FEFF}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]"
view("v_lines", f"""
SELECT batch_id, line_no, regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g') AS line FROM (
  SELECT batch_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM (SELECT batch_id, string_split_regex(text, '\\r?\\n') AS ls FROM v_texts))""")
view("v_parsed", f"""
SELECT batch_id, line_no, token_no, input, input AS title, {provider_sql('input')} || CASE WHEN listed THEN ' playlist' ELSE ' URL' END AS detail,
  CASE WHEN listed THEN 'playlist' ELSE 'video' END AS kind, lower({provider_sql('input')}) AS provider, {url_key_sql('input')} AS candidate_key
FROM (SELECT *, contains(input, 'list=') OR contains(input, '/playlist') OR contains(input, '/sets/') OR contains(input, '/album/') AS listed FROM (
  SELECT batch_id, line_no, regexp_replace(unnest(ts), '^[,;:()\\[\\]<>"'']+|[,;:()\\[\\]<>"'']+$', '', 'g') AS input, generate_subscripts(ts, 1) - 1 AS token_no
  FROM (SELECT *, string_split_regex(line, '\\s+') AS ts FROM v_lines WHERE contains(line, 'http://') OR contains(line, 'https://')))
  WHERE input LIKE 'http://%' OR input LIKE 'https://%')
UNION ALL
SELECT batch_id, line_no, 0, line, CASE WHEN s.path IS NOT NULL THEN regexp_extract(s.path, '([^/]*)$', 1) ELSE line END, CASE WHEN s.path IS NOT NULL THEN 'Local file' ELSE 'YouTube search' END,
  CASE WHEN s.path IS NOT NULL THEN 'local' ELSE 'search' END, CASE WHEN s.path IS NOT NULL THEN 'local' ELSE 'youtube' END,
  CASE WHEN s.path IS NOT NULL THEN 'file:' || lower(regexp_extract(s.path, '([^/]*)$', 1)) ELSE 'search:' || lower(regexp_replace(trim(line), '\\s+', ' ', 'g')) END
FROM (SELECT *, CASE WHEN line LIKE 'file://%' THEN url_decode(regexp_replace(line, '^(file://)+', '')) ELSE line END AS p FROM v_lines WHERE line <> '' AND NOT contains(line, 'http://') AND NOT contains(line, 'https://'))
LEFT JOIN v_storage s ON s.path = p WHERE s.path IS NOT NULL OR strlen(line) <= 180""")
view("v_import", "SELECT * FROM v_parsed QUALIFY row_number() OVER (PARTITION BY batch_id, candidate_key ORDER BY line_no, token_no) = 1")


def parsed(t):
    return I.parse_import_text(t.import_texts, t.storage)


def ordered_candidates(t):
    """Candidates with their place in the whole batch, keys not yet unique across line and token."""
    seq = F.shiftleft(F.col("line_no").cast("bigint"), 32) + F.col("token_no")
    return t.stored("candidates", lambda: parsed(t).withColumn("seq", seq).withColumn("blocked", F.col("line_no") % 11 == 10), spread=True)


view("v_ordered", "SELECT *, line_no::BIGINT * 4294967296 + token_no AS seq, line_no % 11 = 10 AS blocked FROM v_import")


@query("parse_import_text", "SELECT batch_id, line_no::INT AS line_no, token_no::INT AS token_no, input, title, detail, kind, provider, candidate_key FROM v_import")
def parse_import_text(t):
    return parsed(t).select("batch_id", "line_no", "token_no", "input", "title", "detail", "kind", "provider", "candidate_key")


@query("dedupe_candidates", """
SELECT source, kind, candidate_key, input FROM (SELECT *, left(batch_id, 1) AS source FROM v_ordered)
QUALIFY row_number() OVER (PARTITION BY source, candidate_key ORDER BY seq, batch_id) = 1""")
def dedupe_candidates(t):
    whole = ordered_candidates(t).drop("candidate_key")
    # one batch per kind of source: its keys repeat across documents
    pooled = whole.withColumn("seq", F.struct("seq", "batch_id")).withColumn("batch_id", F.left("batch_id", F.lit(1)))
    return K.dedupe_candidates(pooled).select(F.col("batch_id").alias("source"), "kind", "candidate_key", "input")


_GROUP = """CASE WHEN kind = 'search' THEN 'search:youtube:' || lower(regexp_replace(trim(input), '\\s+', ' ', 'g')) WHEN kind = 'playlist' THEN 'playlist:' || input
  WHEN kind = 'video' THEN 'source:' || input ELSE 'direct:' || input END"""
view("v_groups", f"""
SELECT batch_id, seq AS group_seq, {_GROUP} AS group_id, CASE WHEN kind IN ('search', 'playlist') THEN kind ELSE 'direct' END AS group_kind,
  CASE WHEN kind IN ('search', 'playlist', 'video') THEN input END AS query, input AS own_input, blocked AS own_blocked FROM v_ordered""")
view("v_resolved", """
SELECT batch_id, group_id, m AS member_seq, group_id || '#' || m AS input, (m + length(group_id)) % 4 = 0 AS blocked
FROM v_groups, range(4) g(m) WHERE query IS NOT NULL AND m < length(group_id) % 4""")
view("v_members", """
SELECT g.batch_id, group_seq, g.group_id, CASE WHEN g.group_id LIKE 'source:%' AND n > 1 THEN 'playlist' ELSE group_kind END AS group_kind, query,
  coalesce(r.member_seq, 0) AS member_seq, coalesce(r.input, own_input) AS input, coalesce(r.blocked, own_blocked) AS blocked
FROM v_groups g LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY batch_id, group_id) AS n FROM v_resolved) r ON r.batch_id = g.batch_id AND r.group_id = g.group_id
WHERE r.group_id IS NOT NULL OR group_kind = 'direct'""")
_PICK = """
SELECT DISTINCT batch_id, input FROM (SELECT *, count(*) OVER g AS n_all, count(*) FILTER (NOT blocked) OVER g AS n_open,
  min(member_seq) FILTER (NOT blocked) OVER g AS first_open FROM v_members WINDOW g AS (PARTITION BY batch_id, group_id))
WHERE NOT blocked AND (query IS NULL OR group_kind = 'playlist' OR ({0} AND member_seq = first_open))"""


def groups(t):
    return G.candidate_groups(ordered_candidates(t))


def resolved(t):
    size = F.length("group_id")
    return groups(t).where(F.col("query").isNotNull()).select("batch_id", "group_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("member_seq")).where(
        F.col("member_seq") < size % 4
    ).withColumn("input", F.concat("group_id", F.lit("#"), "member_seq")).withColumn("blocked", (F.col("member_seq") + size) % 4 == 0)


def members(t):
    return t.stored("members", lambda: G.group_expand(groups(t), resolved(t)))


@query("group_expand", "SELECT batch_id, group_seq, group_id, group_kind, member_seq::INT AS member_seq, input, blocked FROM v_members")
def group_expand(t):
    return members(t).select("batch_id", "group_seq", "group_id", "group_kind", "member_seq", "input", "blocked")


@query("default_selection", _PICK.format("n_open = 1"))
def default_selection(t):
    return G.default_selection(members(t))


@query("reconcile_selection", f"""
WITH prev AS (SELECT * FROM v_members WHERE group_seq < 12884901888), kept AS (
  SELECT DISTINCT batch_id, input FROM prev WHERE member_seq % 2 = 0 AND (batch_id, input) IN (SELECT (batch_id, input) FROM v_members WHERE NOT blocked)),
fresh AS ({_PICK.format("n_all = 1")})
SELECT batch_id, input FROM kept UNION SELECT batch_id, input FROM fresh WHERE (batch_id, input) NOT IN (SELECT (batch_id, input) FROM prev)""")
def reconcile_selection(t):
    previous = members(t).where("group_seq < 12884901888")
    return G.reconcile_selection(previous.where("member_seq % 2 = 0"), previous, members(t))


@query("source_duplicates", """
WITH inc AS (SELECT source_path AS path FROM v_tracks WHERE user_id % 2 = 0 UNION SELECT '/orig/' || user_id || '.wav' FROM v_tracks UNION SELECT '/new/' || user_id FROM v_tracks)
SELECT path FROM inc WHERE path IN (SELECT source_path FROM v_tracks) OR path IN (SELECT original_source_path FROM v_tracks WHERE original_source_path IS NOT NULL)""")
def source_duplicates(t):
    u = F.col("user_id").cast("string")
    incoming = t.tracks.where("user_id % 2 = 0").select(F.col("source_path").alias("path")).unionByName(
        t.tracks.select(F.concat(F.lit("/orig/"), u, F.lit(".wav")).alias("path"))).unionByName(
        t.tracks.select(F.concat(F.lit("/new/"), u).alias("path"))).distinct()
    return K.source_duplicates(incoming, t.tracks)


@query("missing_media", "SELECT track_id, source_path FROM v_tracks WHERE user_id % 5 = 0")
def missing_media(t):
    listing = t.tracks.where("user_id % 5 <> 0").select(F.col("source_path").alias("path"))
    return K.missing_media(t.tracks, listing).select("track_id", "source_path")


@query("playlist_reorder", """
WITH tr AS (SELECT project_id, track_id, row_number() OVER (PARTITION BY project_id ORDER BY position) - 1 AS p, count(*) OVER (PARTITION BY project_id) AS n FROM v_tracks),
mv AS (SELECT project_id, max(track_id) AS moved, min(n) AS n, least(length(project_id) * 4, min(n) - 1) AS dest FROM tr GROUP BY project_id),
rest AS (SELECT tr.*, row_number() OVER (PARTITION BY project_id ORDER BY p) - 1 AS r FROM tr JOIN mv USING (project_id) WHERE track_id <> moved)
SELECT project_id, track_id, r + CASE WHEN r >= dest THEN 1 ELSE 0 END AS position FROM rest JOIN mv USING (project_id) UNION ALL SELECT project_id, moved, dest FROM mv""")
def playlist_reorder(t):
    dense = K.dense_positions(t.tracks.select("project_id", "track_id", "position"))
    moves = dense.groupBy("project_id").agg(F.max("track_id").alias("track_id")).withColumn("new_index", (F.length("project_id") * 4).cast("bigint"))
    return K.playlist_reorder(dense, moves)


@query("audio_format_filter", f"""
SELECT page_id, k, path, e IN {tuple(V.CATALOGUE_FORMATS)} AS catalogue, e IN {tuple(V.DROPPABLE_FORMATS)} AS droppable FROM (
  SELECT *, lower(regexp_extract(regexp_extract(path, '^([^?#]*)', 1), '\\.([^.]*)$', 1)) AS e FROM (
  SELECT page_id, k, url || ['.MP3', '.ogg?x=.wav', '.flac#a', ''][k + 1] AS path FROM pages, range(4) g(k)))""")
def audio_format_filter(t):
    ends = F.array(*[F.lit(x) for x in (".MP3", ".ogg?x=.wav", ".flac#a", "")])
    rows = t.source("pages").select("page_id", "url", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(4)])).alias("k"))
    rows = rows.select("page_id", "k", F.concat("url", F.get(ends, F.col("k").cast("int"))).alias("path"))
    return rows.select("*", K.playable_format(F.col("path")).alias("catalogue"), K.droppable(F.col("path")).alias("droppable"))


_FAIL = ["does not pass filter (is_live)", "FFmpeg not found", "Sign in to confirm", "This is DRM protected", "Private video", "geo restricted", "needs Deno", "HTTP Error 403: Forbidden", "Connection reset", "??"]


@query("error_class", f"""
SELECT event_id, CASE WHEN k = 9 THEN 'other' ELSE {[r[0] for r in V.ERROR_RULES]}[k + 1] END AS error_class FROM (SELECT event_id, event_id % 10 AS k FROM v_ev)""")
def error_class(t):
    text = F.concat(F.lit("ERROR: "), F.get(F.array(*[F.lit(x) for x in _FAIL]), (F.col("event_id") % 10).cast("int")), F.lit(" at "), "track_id")
    return t.events.select("event_id", X.error_class(text)[0].alias("error_class"))


view("v_playlist", """
SELECT 'https://www.youtube.com/playlist?list=' || (page_id // 5) AS playlist_url, page_id AS seq, 'v' || (page_id // 2) AS id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'Song ' || page_id END AS title,
  NULL AS link, NULL AS fmt FROM pages
UNION ALL SELECT 'https://soundcloud.com/a/sets/' || (page_id // 5), page_id, NULL, CASE WHEN page_id % 3 = 0 THEN ' ' ELSE 'Song ' || page_id END,
  CASE WHEN page_id % 4 = 0 THEN 'https://example.org/x' ELSE 'https://soundcloud.com/a/' || (page_id // 2) END, CASE WHEN page_id % 2 = 0 THEN 'mp3' END FROM pages""")


@query("scan_playlist_entries", f"""
SELECT playlist_url, seq, url AS source_url, title, blocked FROM (
  SELECT playlist_url, seq, CASE WHEN id IS NOT NULL THEN 'https://www.youtube.com/watch?v=' || id ELSE link END AS url,
    CASE WHEN trim(title) <> '' THEN title WHEN id IS NOT NULL THEN id ELSE 'SoundCloud track' END AS title, id IS NULL AND fmt IS NULL AS blocked
  FROM v_playlist WHERE id IS NOT NULL OR link LIKE '%soundcloud%') QUALIFY row_number() OVER (PARTITION BY playlist_url, url ORDER BY seq) = 1""")
def scan_playlist_entries(t):
    p = F.col("page_id")
    half, fifth, pid = F.floor(p / 2).cast("string"), F.floor(p / 5).cast("string"), p.cast("string")
    song = F.concat(F.lit("Song "), pid)
    videos = t.source("pages").select(
        F.concat(F.lit("https://www.youtube.com/playlist?list="), fifth).alias("playlist_url"), p.alias("seq"),
        F.to_json(F.struct(F.concat(F.lit("v"), half).alias("id"), F.when(p % 3 != 0, song).alias("title"))).alias("json"))
    others = t.source("pages").select(
        F.concat(F.lit("https://soundcloud.com/a/sets/"), fifth).alias("playlist_url"), p.alias("seq"),
        F.to_json(F.struct(
            F.when(p % 3 == 0, F.lit(" ")).otherwise(song).alias("title"),
            F.when(p % 4 == 0, F.lit("https://example.org/x")).otherwise(F.concat(F.lit("https://soundcloud.com/a/"), half)).alias("webpage_url"),
            F.when(p % 2 == 0, F.lit("mp3")).alias("format_id"))).alias("json"))
    return SR.scan_playlist_entries(videos.unionByName(others)).select("playlist_url", "seq", "source_url", "title", "blocked")


def _infos(t):
    """Chapter documents: one per part of 600 events of a user, bounded by construction."""
    start = F.when(F.col("event_id") % 13 == 0, F.lit(-1.0)).otherwise(F.col("beat_us") / 1e6)
    label = F.when(F.col("event_id") % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" Verse "), F.col("event_id"), F.lit(" ")))
    end = F.when(F.col("event_id") % 2 == 0, (F.col("beat_us") + 700000 * (F.col("event_id") % 3 - 1)) / 1e6)
    chapter = F.struct(F.col("event_id").alias("o"), label.alias("title"), start.alias("start_time"), end.alias("end_time"))
    return t.events.groupBy("track_id", F.floor(F.col("event_id") / 100000).alias("part")).agg(F.array_sort(F.collect_list(chapter)).alias("chapters")).select(
        F.concat("track_id", F.lit("/"), "part").alias("track_id"), F.to_json(F.struct("chapters")).alias("json"))


@query("chapters_to_markers", """
SELECT track_id || '/' || (event_id // 100000) AS track_id, 'Verse ' || event_id AS label, beat_us / 1e6 AS start_s,
  CASE WHEN event_id % 2 = 0 AND event_id % 3 = 2 THEN (beat_us + 700000) / 1e6 END AS end_s FROM v_ev WHERE event_id % 13 <> 0 AND event_id % 11 <> 0""")
def chapters_to_markers(t):
    return I.chapters_to_markers(_infos(t)).select("track_id", "label", "start_s", "end_s")


@query("clip_markers_to_track", """
SELECT m.track_id, marker_id, start_s, CASE WHEN end_s IS NOT NULL AND least(end_s, d) > start_s THEN least(end_s, d) END AS end_s
FROM (SELECT track_id, marker_id, start_s, CASE WHEN end_us IS NOT NULL THEN end_s END AS end_s FROM v_markers) m JOIN (SELECT track_id, duration_us / 2e6 AS d FROM v_tracks) USING (track_id) WHERE start_s < d""")
def clip_markers_to_track(t):
    short = t.tracks.select("track_id", (F.col("duration_us") / 2e6).alias("duration_s"))
    return I.clip_markers_to_track(t.markers.select("track_id", "marker_id", "start_s", "end_s"), short)


def _named(t):
    return t.tracks.select("project_id").distinct().withColumn("name", F.concat(F.lit('Set "'), "project_id", F.lit('"')))


@query("export_playlist", """
SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY position, track_id) AS position, title, duration_s AS "durationSeconds" FROM v_tracks""")
def export_playlist(t):
    lines = D.export_playlist(_named(t), t.tracks).where(F.col("line").startswith('{"position"'))
    row = F.from_json(F.regexp_replace("line", ",$", ""), "position bigint, title string, durationSeconds double").alias("r")
    return lines.select("project_id", row).select("project_id", "r.*")


def _frames(lines, keys: list[str]):
    """Of each document its first and last line, its lines, and those that end in a comma as all but the last of a list do."""
    ends = {"head": F.min_by("line", "line_no"), "tail": F.max_by("line", "line_no")}
    listed = F.count_if(F.col("line").endswith("},"))
    return lines.groupBy(*keys).agg(*(v.alias(n) for n, v in ends.items()), F.count(F.lit(1)).alias("n_lines"), F.countDistinct("line_no").alias("n_places"), listed.alias("n_commas"))


@query("export_playlist_frame", """
SELECT project_id, '{"project":"Set \\"' || project_id || '\\"","tracks":[' AS head, ']}' AS tail, count(*) + 2 AS n_lines, count(*) + 2 AS n_places, count(*) - 1 AS n_commas FROM v_tracks GROUP BY ALL""")
def export_playlist_frame(t):
    return _frames(D.export_playlist(_named(t), t.tracks), ["project_id"])


@query("export_playlist_markdown", """
SELECT project_id, i AS line_no, line FROM (SELECT DISTINCT project_id FROM v_tracks), (VALUES (0::BIGINT), (1), (2), (3)) v(i), LATERAL (SELECT CASE i WHEN 0 THEN '# Set "' || project_id || '"' WHEN 1 THEN ''
  WHEN 2 THEN '| # | Song | Duration | Notes |' ELSE '|---:|---|---:|---|' END AS line)
UNION ALL SELECT project_id, n + 3, '| ' || n || ' | ' || title || ' | ' || (d // 60) || ':' || CASE WHEN d % 60 < 10 THEN '0' ELSE '' END || (d % 60) || ' |  |'
FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY position, track_id) AS n, floor(duration_s + 5e-1)::BIGINT AS d FROM v_tracks)""")
def export_playlist_markdown(t):
    return D.export_playlist(_named(t), t.tracks, "markdown")


@query("export_jams", """
SELECT track_id, mode, start_s AS time, round(greatest(0, end_s - start_s), 6) AS duration, source_label AS value, strength AS confidence FROM v_compact""")
def export_jams(t):
    lines = D.export_jams(compact(t), t.tracks).where(F.col("line").startswith('{"time"'))
    row = F.from_json(F.regexp_replace("line", ",$", ""), "time double, duration double, value string, confidence double").alias("r")
    return lines.select("track_id", "mode", row).select("track_id", "mode", "r.time", F.round("r.duration", 6).alias("duration"), "r.value", "r.confidence")


@query("export_jams_frame", """
SELECT track_id, mode, '{"jams_version":"0.3.5","file_metadata":{"title":"' || title || '","artist":"","release":"","duration":#,"identifiers":{}},"annotations":[{"namespace":"chord","annotation_metadata":{"curator":{"name":"stave","email":""},"annotator":{},"version":"1","corpus":"","annotation_tools":"stave","annotation_rules":"","validation":"","data_source":"automatic"},"data":[' AS head,
  '],"sandbox":{"chord_mode":"' || mode || '"}}],"sandbox":{}}' AS tail, n + 2 AS n_lines, n + 2 AS n_places, n - 1 AS n_commas, duration_s
FROM (SELECT track_id, mode, count(*) AS n FROM v_compact GROUP BY ALL) JOIN (SELECT track_id, title, duration_s FROM v_tracks) USING (track_id)""")
def export_jams_frame(t):
    made = _frames(D.export_jams(compact(t), t.tracks), ["track_id", "mode"])
    number = r'"duration":([^,]*),"identifiers"'
    return made.withColumn("duration_s", F.regexp_extract("head", number, 1).cast("double")).withColumn("head", F.regexp_replace("head", number, '"duration":#,"identifiers"'))



@query("format_time", """
SELECT event_id, CASE WHEN m < 10 THEN '0' ELSE '' END || m || ':' || CASE WHEN s < 10 THEN '0' ELSE '' END || s AS clock,
  CASE WHEN ms // 60000 < 10 THEN '0' ELSE '' END || (ms // 60000) || ':' || lpad(((ms % 60000) // 1000)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') AS precise,
  CASE WHEN abs(p) < 1 THEN CASE WHEN c > 0 THEN '+' ELSE '' END || c || ' ct' ELSE CASE WHEN p > 0 THEN '+' ELSE '' END || printf('%.2f', p) || ' st' END AS pitch
FROM (SELECT *, floor(t / 60)::BIGINT AS m, floor(t)::BIGINT % 60 AS s, floor(t * 1000 + 5e-1)::BIGINT AS ms, floor(p * 100 + 5e-1)::BIGINT AS c
  FROM (SELECT event_id, value * 20 AS t, (event_id % 97 - 48) / 4 AS p FROM v_ev))""")
def format_time(t):
    rows = t.events.select("event_id", (F.col("value") * 20).alias("t"), ((F.col("event_id") % 97 - 48) / 4).alias("p"))
    return rows.select("event_id", S.clock(F.col("t")).alias("clock"), S.clock_ms(F.col("t")).alias("precise"), S.pitch_text(F.col("p")).alias("pitch"))
