"""The registered queries again as plain SQL, for comparison in DuckDB.

The SQL follows the definitions directly: all pairs of posts, all terms, recursion for the windows and
for the merges of clusters, one at a time.
"""

from __future__ import annotations

from burstline.functions import text as tx
from burstline.functions.words import STOP_WORDS
from burstline.plans.queries import EVENT_MINUTES, PARAMS, PHRASES, SHORT_LINE, TOP_TERMS, USER_MINUTES, WIDE
from burstline.sources.tables import DOCUMENT_SECONDS, FIRST_SECOND, LINES_PER_DOCUMENT


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items: list[str]) -> str:
    return "[" + ", ".join(_lit(s) for s in items) + "]"


_SPACE = r"[ \t\n\r\f\v]"
_WORD = r"[^ \t\n\r\f\v]+"
_LENGTH = int(PARAMS.window_minutes * 60)
_STOP = _list(sorted(set(STOP_WORDS)))


def _distinct(items: str) -> str:
    return f"list_filter({items}, lambda v, k: list_position({items}, v) = k)"


def _millionths(x: str, name: str) -> str:
    return f"CAST(round({x} * 1000000) AS BIGINT) AS {name}"


def _merging(points: str, name: str, profiles: str, cuts: str) -> str:
    """Average linkage, one merge per window and step, down to the cut."""
    return f"""
        SELECT window_id, {name}, {name} AS label, 0 AS step FROM {points}
        UNION ALL
        SELECT m.window_id, m.{name}, CASE WHEN m.label = b THEN a ELSE m.label END, step + 1
        FROM @self m JOIN (
            SELECT window_id, arg_min(a, (d, a, b)) AS a, arg_min(b, (d, a, b)) AS b FROM (
                SELECT l.window_id, l.label AS a, r.label AS b, round(avg(e), 9) AS d
                FROM @self l JOIN {profiles} p ON p.window_id = l.window_id AND p.x = l.{name}
                JOIN @self r ON r.window_id = p.window_id AND r.{name} = p.y
                WHERE l.label < r.label GROUP BY ALL) JOIN {cuts} USING (window_id)
            WHERE d <= round(cut, 9) GROUP BY window_id) USING (window_id)"""


# steps by name: each may read the steps it lists
_STEPS: dict[str, tuple[list[str], str]] = {
    "all_posts": ([], f"""
        SELECT doc_id * {LINES_PER_DOCUMENT} + k - 1 AS post_id,
               {FIRST_SECOND} + doc_id * {DOCUMENT_SECONDS} + k - 1 AS second, ls[k] AS text, lang,
               regexp_extract_all(ls[k], '@(\\w+)', 1) AS users,
               regexp_extract_all(ls[k], '#(\\w+)', 1) AS hashtags,
               CASE WHEN url IS NULL THEN [] ELSE [url] END AS media_urls
        FROM (SELECT *, unnest(generate_series(1, len(ls))) AS k
              FROM (SELECT doc_id, lang, url, string_split(text, chr(10)) AS ls
                    FROM documents LEFT JOIN pages ON page_id = doc_id))"""),
    "posts": (["all_posts"], "SELECT * FROM all_posts WHERE lang = 'en'"),
    "clean": (["posts"], "SELECT * FROM posts WHERE " + " AND ".join(
        f"NOT contains(text, {_lit(p)})" for p in PHRASES)),
    "windowed": (["clean"], f"SELECT *, second - second % {_LENGTH} AS window_id FROM clean"),
    "shown": (["posts"], f"""
        SELECT post_id, translate(regexp_replace(text, '(www\\.{_WORD})|(https?://{_WORD})|(pic\\.twitter\\.com/{_WORD})',
               '', 'g'), chr(10) || chr(9), '  ') AS shown FROM posts"""),
    "sequence": (["windowed"], f"""
        SELECT window_id, window_seq, (window_seq - 1) // {PARAMS.history_windows} AS block,
               (window_seq - 1) % {PARAMS.history_windows} + 1 AS place
        FROM (SELECT window_id, row_number() OVER (ORDER BY window_id) AS window_seq
              FROM (SELECT DISTINCT window_id FROM windowed))"""),
    "terms": (["eligible"], """
        SELECT window_id, post_id, unnest(list_distinct(list_concat(
            list_transform(range(1, len(f)), lambda i: array_to_string(f[i:i + 1], ' ')),
            list_transform(range(1, len(f) - 1), lambda i: array_to_string(f[i:i + 2], ' '))))) AS term
        FROM (SELECT window_id, post_id,
                     list_transform(list_filter(bag, lambda t: NOT contains(t, '@')), lambda t: lower(trim(t))) AS f
              FROM eligible)"""),
    "vocab": (["terms", "eligible"], f"""
        SELECT window_id, term, count(*) AS df FROM terms
        JOIN (SELECT window_id, count(*) AS n FROM eligible GROUP BY ALL) USING (window_id)
        GROUP BY window_id, term, n
        HAVING count(*) >= greatest(floor(n * CAST({PARAMS.min_df_share} AS DOUBLE)), {PARAMS.min_df_floor})"""),
    "held": (["terms", "vocab"], f"""
        SELECT window_id, post_id, term FROM terms SEMI JOIN vocab USING (window_id, term)
        QUALIFY count(*) OVER (PARTITION BY post_id) > {PARAMS.min_post_terms}"""),
    "pruned": (["held"], """
        SELECT window_id, post_id, string_agg(term, '|' ORDER BY term) AS terms FROM held GROUP BY ALL"""),
    "pats": (["pruned", "windowed"], """
        SELECT window_id, arg_min(post_id, (second, post_id)) AS pattern_id, count(*) AS n_posts, terms
        FROM pruned JOIN windowed USING (window_id, post_id) GROUP BY window_id, terms"""),
    "dfs": (["vocab", "held"], """
        SELECT window_id, v.term, count(h.post_id) AS df
        FROM vocab v LEFT JOIN held h USING (window_id, term) GROUP BY ALL"""),
    "history": (["dfs", "sequence"], """
        SELECT window_id, term, df, CASE WHEN place = 1 THEN 0 ELSE coalesce(sum(df) OVER (
            PARTITION BY block, term ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            / CAST(place - 1 AS DOUBLE) END AS avg_df
        FROM dfs JOIN sequence USING (window_id)"""),
    "lexicon": ([], """
        SELECT DISTINCT lower(w) AS word FROM
            (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM benchmark)
        WHERE regexp_matches(w, '^[A-Z]') AND length(w) > 1"""),
    "weights": (["history", "lexicon"], """
        SELECT window_id, term, (df + 1) / (ln(avg_df + 1) + 1) AS weight,
               (df + 1) / (ln(avg_df + 1) + 1) * CASE WHEN b.term IS NULL THEN 1.0::DOUBLE ELSE 2.5::DOUBLE END AS boosted
        FROM history LEFT JOIN (
            SELECT DISTINCT term FROM (SELECT term, unnest(string_split(term, ' ')) AS word
                                       FROM (SELECT DISTINCT term FROM history)) SEMI JOIN lexicon USING (word)
        ) b USING (term)"""),
    "shares": (["held"], """
        SELECT window_id, term, count(*) / CAST(m AS DOUBLE) AS p FROM held
        JOIN (SELECT window_id, count(DISTINCT post_id) AS m FROM held GROUP BY ALL) USING (window_id)
        GROUP BY window_id, term, m HAVING count(*) < m"""),
    "norms": (["pruned", "held", "shares"], """
        SELECT window_id, post_id, coalesce(a, 0) AS a, c,
               sqrt(coalesce(s, 0) - 2 * coalesce(a, 0) + c) AS norm
        FROM pruned
        LEFT JOIN (SELECT window_id, post_id, sum(1 / (1 - p)) AS a, sum(1 / (p * (1 - p))) AS s
                   FROM held JOIN shares USING (window_id, term) GROUP BY ALL) USING (window_id, post_id)
        JOIN (SELECT window_id, sum(p / (1 - p)) AS c FROM shares GROUP BY ALL) USING (window_id)"""),
    "shared": (["held", "shares"], """
        SELECT window_id, h.post_id AS x, k.post_id AS y, sum(1 / (p * (1 - p))) AS s
        FROM held h JOIN held k USING (window_id, term) JOIN shares USING (window_id, term) GROUP BY ALL"""),
    "distances": (["norms", "shared"], """
        SELECT window_id, i.post_id AS x, j.post_id AS y,
               CASE WHEN i.post_id = j.post_id THEN 0
                    ELSE 1 - (coalesce(s, 0) - i.a - j.a + i.c) / (i.norm * j.norm) END AS d
        FROM norms i JOIN norms j USING (window_id)
        LEFT JOIN shared o ON o.window_id = i.window_id AND o.x = i.post_id AND o.y = j.post_id"""),
    "cuts": (["distances"], f"""
        SELECT window_id, max(d) AS max_distance, max(d) * CAST({PARAMS.cut_share} AS DOUBLE) AS cut
        FROM distances GROUP BY ALL"""),
    "near": (["distances", "cuts", "pats"], """
        SELECT window_id, x, y, d FROM distances JOIN cuts USING (window_id)
        JOIN (SELECT window_id, pattern_id AS x, n_posts AS wx FROM pats) USING (window_id, x)
        JOIN (SELECT window_id, pattern_id AS y, n_posts AS wy FROM pats) USING (window_id, y)
        WHERE x < y AND d <= cut / sqrt(wx + wy) + 1e-9"""),
    "profiles": (["distances"], """
        SELECT window_id, p.x, q.x AS y, sqrt(sum((p.d - q.d) * (p.d - q.d))) AS e
        FROM distances p JOIN distances q USING (window_id) WHERE p.y = q.y GROUP BY ALL"""),
    "merging": (["pruned", "profiles", "cuts"], _merging("pruned", "post_id", "profiles", "cuts")),
    "labels": (["merging"], """
        SELECT window_id, post_id, arg_max(label, step) AS cluster_id FROM merging GROUP BY ALL"""),
    "sizes": (["labels", "windowed"], """
        SELECT window_id, cluster_id, count(*) AS size, min((second, post_id)) AS first,
               arg_min(post_id, (second, post_id)) AS post_id
        FROM labels JOIN windowed USING (window_id, post_id) GROUP BY ALL"""),
    "listed": (["sizes"], f"""
        SELECT *, size >= gate AS gated FROM (
            SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY size DESC, first) AS by_size,
                   greatest(floor(sum(size) OVER (PARTITION BY window_id) * CAST({PARAMS.cluster_share} AS DOUBLE)),
                            {PARAMS.cluster_floor}) AS gate
            FROM sizes)
        QUALIFY by_size <= {PARAMS.max_clusters}
            AND (gated OR by_size = 1 OR lag(gated) OVER (PARTITION BY window_id ORDER BY by_size))"""),
    "scored": (["listed", "labels", "held", "weights"], f"""
        SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY round(score, 9) DESC, first) AS rank FROM (
            SELECT l.*, CASE WHEN gated THEN best / size ELSE 0 END AS score
            FROM listed l JOIN (
                SELECT window_id, cluster_id, max(boosted) AS best FROM labels JOIN held USING (window_id, post_id)
                JOIN weights USING (window_id, term) GROUP BY ALL) USING (window_id, cluster_id))
        QUALIFY rank <= {PARAMS.max_headlines}"""),
    "headlines": (["scored", "eligible"], """
        SELECT s.*, text, media_urls, bag,
               list_filter(bag, lambda t: NOT contains(t, '@') AND NOT contains(t, '#')) AS said,
               list_distinct(list_transform(said, lambda t: lower(trim(t)))) AS words
        FROM scored s JOIN eligible USING (window_id, post_id)"""),
    "h_distances": (["headlines"], """
        SELECT window_id, i.rank AS x, j.rank AS y, CASE WHEN i.rank = j.rank THEN 0
               ELSE 1 - len(list_intersect(i.words, j.words)) / sqrt(len(i.words) * len(j.words)) END AS d
        FROM headlines i JOIN headlines j USING (window_id)"""),
    "h_profiles": (["h_distances"], """
        SELECT window_id, p.x, q.x AS y, sqrt(sum((p.d - q.d) * (p.d - q.d))) AS e
        FROM h_distances p JOIN h_distances q USING (window_id) WHERE p.y = q.y GROUP BY ALL"""),
    "h_cuts": (["h_distances"], f"""
        SELECT window_id, max(d) * CAST({PARAMS.headline_cut_share} AS DOUBLE) AS cut FROM h_distances GROUP BY ALL"""),
    "h_merging": (["headlines", "h_profiles", "h_cuts"], _merging("headlines", "rank", "h_profiles", "h_cuts")),
    "grouped": (["h_merging", "headlines"], """
        SELECT h.*, topic FROM headlines h
        JOIN (SELECT window_id, rank, arg_max(label, step) AS topic FROM h_merging GROUP BY ALL) USING (window_id, rank)"""),
    "ranked": (["grouped"], f"""
        SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY round(score, 9) DESC, first) AS rank
        FROM (SELECT window_id, topic, max(score) AS score, min(first) AS first FROM grouped GROUP BY ALL)
        QUALIFY rank <= {PARAMS.max_topics}"""),
    "members": (["ranked", "grouped", "cleaned"], """
        SELECT r.window_id, r.topic, g.rank AS place, g.cluster_id, g.post_id, g.media_urls, g.bag, g.said, c.shown
        FROM ranked r JOIN grouped g USING (window_id, topic) JOIN cleaned c USING (post_id)"""),
    "cleaned": (["shown", "eligible"], """
        SELECT post_id, window_id, second, shown, media_urls FROM eligible JOIN shown USING (post_id)"""),
    "fallback": (["members", "labels", "cleaned"], """
        SELECT window_id, topic, arg_min(post_id, (place, second, post_id)) AS extra,
               arg_min(media_urls, (place, second, post_id)) AS extra_media
        FROM (SELECT m.window_id, m.topic, m.place, c.second, c.post_id, c.media_urls, c.shown
              FROM members m JOIN labels l USING (window_id, cluster_id)
              JOIN cleaned c ON c.post_id = l.post_id
              WHERE len(c.media_urls) > 0
                AND NOT EXISTS (SELECT 1 FROM members n WHERE n.window_id = m.window_id AND n.topic = m.topic
                    AND (len(n.media_urls) > 0 OR n.post_id = c.post_id OR trim(n.shown) = trim(c.shown))))
        GROUP BY ALL"""),
    "topics": (["ranked", "members", "fallback"], f"""
        SELECT window_id, strftime(make_timestamp(window_id * 1000000), '%d-%m-%Y %H:%M') AS window_label, rank,
               {_millionths('score', 'score')}, headline, label,
               array_to_string(list_sort(list_distinct(list_transform(bags, lambda t: lower(t)))), ', ') AS keywords,
               array_to_string(CASE WHEN extra IS NULL THEN posts ELSE list_append(posts, extra) END, ', ') AS post_ids,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(media, coalesce(extra_media, [])))), ', '), '')
                   AS media_urls
        FROM ranked JOIN (
            SELECT window_id, topic, arg_min(shown, place) AS headline,
                   string_agg(array_to_string(said, ' ') || '//', '' ORDER BY place) AS label,
                   flatten(list(bag)) AS bags, list(post_id ORDER BY place) AS posts, flatten(list(media_urls)) AS media
            FROM members GROUP BY ALL) USING (window_id, topic)
        LEFT JOIN fallback USING (window_id, topic)"""),
    "eligible": (["words"], """
        SELECT * FROM bags WHERE len(users) < 3 AND len(hashtags) < 3 AND len(words) > 3 AND len(bag) >= 4
            AND upper(array_to_string(words, ' ')) <> array_to_string(words, ' ')"""),
}


def _windows_of(minutes: float) -> dict[str, tuple[list[str], str]]:
    length = int(minutes * 60)
    return {"windowed": (["clean"], f"SELECT *, second - second % {length} AS window_id FROM clean")}


# the same steps over anchored windows: `windowed` without closing posts and the open tail
_ANCHORED = {
    "chain_seconds": (["clean"], "SELECT DISTINCT second AS u FROM clean"),
    "chain_hop": (["chain_seconds"], f"""
        SELECT a.u, b.u AS n FROM (SELECT u, u + {_LENGTH} AS q FROM chain_seconds) a
        ASOF JOIN chain_seconds b ON a.q <= b.u"""),
    "chain": (["chain_hop"], "SELECT min(u) AS u FROM chain_seconds UNION ALL SELECT n FROM @self JOIN chain_hop USING (u)"),
    "placed": (["chain"], "SELECT clean.*, u AS window_id FROM clean ASOF JOIN chain ON second >= u"),
    "windowed": (["placed"], """
        SELECT * FROM placed QUALIFY (row_number() OVER (PARTITION BY window_id ORDER BY second, post_id) > 1
            OR window_id = (SELECT min(window_id) FROM placed)) AND window_id < (SELECT max(window_id) FROM placed)"""),
    "closed": (["placed"], "SELECT DISTINCT window_id FROM placed WHERE window_id < (SELECT max(window_id) FROM placed)"),
}


def _text_steps(base: str) -> dict[str, tuple[list[str], str]]:
    """Text steps over `base`: all posts, or those in windows."""
    return {
        "normal": ([base], f"""
            SELECT *, translate(regexp_replace(regexp_replace(text,
                '(www\\.|https?://|pic\\.twitter\\.com/|@|#){_WORD}', '', 'g'), '[\\x{{10000}}-\\x{{10FFFF}}]', ' ', 'g'),
                {_lit(tx.BLANKED_CHARS + tx.DELETED_CHARS)}, {_lit(' ' * len(tx.BLANKED_CHARS))}) AS normalized
            FROM {base}"""),
        "words": (["normal"], f"""
            SELECT *, list_filter(regexp_split_to_array(normalized, '{_SPACE}+'),
                lambda w: length(w) > 1 AND NOT list_contains({_STOP}, lower(w))) AS words FROM normal"""),
        "bags": (["words"], f"""
            SELECT *, list_concat(list_concat(
                list_transform({_distinct('users')}, lambda u: '@' || lower(u)),
                list_transform(list_filter({_distinct('hashtags')}, lambda t: NOT list_contains({_STOP}, lower(t))),
                               lambda t: '#' || lower(t))), words) AS bag FROM words"""),
        "eligible": (["bags"], _STEPS["eligible"][1]),
    }


def _with(final: str, *needs: str, base: str = "windowed", over: dict[str, tuple[list[str], str]] | None = None) -> str:
    steps = {**_STEPS, **_text_steps(base), **(over or {})}
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        for need in steps[name][0]:
            add(need)
        done[name] = steps[name][1]

    for need in needs:
        add(need)
    ctes = ",\n".join(
        f"{n} AS ({sql.replace('@self', n)})" if "@self" in sql else f"{n} AS MATERIALIZED ({sql})"
        for n, sql in done.items())
    return f"WITH RECURSIVE {ctes}\n{final}"


def _anchored(source: str, second: str, length: int) -> str:
    """CTEs `chain(u)`: the window starts of `source`."""
    return f"""
        seconds AS MATERIALIZED (SELECT DISTINCT {second} AS u FROM {source}),
        hop AS MATERIALIZED (SELECT a.u, b.u AS n FROM (SELECT u, u + {length} AS q FROM seconds) a
                ASOF JOIN seconds b ON a.q <= b.u),
        chain AS (SELECT min(u) AS u FROM seconds UNION ALL SELECT n FROM chain JOIN hop USING (u))"""


def _anchored_windows() -> str:
    base = _with("", "clean").rstrip()
    return base + "," + _anchored("clean", "second", _LENGTH) + """,
        placed AS MATERIALIZED (SELECT post_id, second, u AS window_id FROM clean ASOF JOIN chain ON second >= u),
        kept AS (SELECT * FROM placed QUALIFY (row_number() OVER (PARTITION BY window_id ORDER BY second, post_id) > 1
                 OR window_id = (SELECT min(u) FROM chain)) AND window_id < (SELECT max(window_id) FROM placed))
        SELECT post_id, window_id, window_seq FROM kept
        JOIN (SELECT u AS window_id, row_number() OVER (ORDER BY u) AS window_seq FROM chain) USING (window_id)"""


def _anchored_events() -> str:
    return ("WITH RECURSIVE timed AS MATERIALIZED (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS second FROM events),"
            + _anchored("timed", "second", EVENT_MINUTES * 60)
            + "SELECT event_id, u AS window_id FROM timed ASOF JOIN chain ON second >= u")


def _anchored_users() -> str:
    return f"""
        WITH RECURSIVE timed AS MATERIALIZED (
            SELECT user_id, event_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS second FROM events),
        seconds AS MATERIALIZED (SELECT DISTINCT user_id, second AS u FROM timed),
        hop AS MATERIALIZED (SELECT a.user_id, a.u, b.u AS n
            FROM (SELECT user_id, u, u + {USER_MINUTES * 60} AS q FROM seconds) a
            ASOF JOIN seconds b ON a.user_id = b.user_id AND a.q <= b.u),
        chain AS (SELECT user_id, min(u) AS u, 1 AS seq FROM seconds GROUP BY user_id
            UNION ALL SELECT user_id, n, seq + 1 FROM chain JOIN hop USING (user_id, u)),
        placed AS (SELECT t.user_id, event_id, ts, u AS window_id, seq AS window_seq
            FROM timed t ASOF JOIN chain c ON t.user_id = c.user_id AND t.second >= c.u)
        SELECT user_id, event_id, window_id, CAST(window_seq AS BIGINT) AS window_seq,
               CAST((window_seq - 1) // {PARAMS.history_windows} AS BIGINT) AS block,
               CAST((window_seq - 1) % {PARAMS.history_windows} + 1 AS BIGINT) AS place
        FROM placed
        QUALIFY (row_number() OVER (PARTITION BY user_id, window_id ORDER BY ts, event_id) > 1 OR window_seq = 1)
            AND window_seq < max(window_seq) OVER (PARTITION BY user_id)"""


_ITEM_PHRASES = """
    SELECT DISTINCT array_to_string(w[2:4], ' ') AS phrase
    FROM (SELECT string_split(regexp_replace(text, '[ \\n]+', ' ', 'g'), ' ') AS w FROM benchmark) WHERE len(w) >= 4"""
_SHORT_WORDS = """
    SELECT list(DISTINCT lower(w)) AS stop FROM
        (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM benchmark) WHERE length(w) BETWEEN 1 AND 4"""

ORACLE: dict[str, str] = {
    "lang_filter": _with("SELECT post_id, lang, text FROM posts", "posts"),
    "spam_filter": _with("SELECT post_id, text FROM clean", "clean"),
    "spam_by_table": _with(f"""SELECT post_id, text FROM clean
        WHERE NOT EXISTS (SELECT 1 FROM ({_ITEM_PHRASES}) WHERE contains(text, phrase))""", "clean"),
    "bag_by_table": _with(f"""
        SELECT post_id, array_to_string(words, ' ') AS words,
               array_to_string(list_concat(list_concat(list_transform({_distinct('users')}, lambda u: '@' || lower(u)),
                   list_transform(list_filter({_distinct('hashtags')}, lambda t: NOT list_contains(stop, lower(t))),
                                  lambda t: '#' || lower(t))), words), ',') AS bag
        FROM (SELECT *, list_filter(regexp_split_to_array(normalized, '{_SPACE}+'),
                  lambda w: length(w) > 1 AND NOT list_contains(stop, lower(w))) AS words
              FROM normal, ({_SHORT_WORDS}))""", "normal", base="posts"),
    "deduped_posts": _with("""
        SELECT post_id, min(second) AS second, arg_min(text, (second, text)) AS text FROM (
            SELECT post_id, second, text FROM posts
            UNION ALL SELECT post_id, second + 3600, 'later' FROM posts WHERE post_id % 3 = 0
            UNION ALL SELECT post_id, second - 3600, text || ' earlier' FROM posts WHERE post_id % 5 = 0
            UNION ALL SELECT post_id, second, '  ' || text FROM posts WHERE post_id % 7 = 0) GROUP BY post_id""", "posts"),
    "display_clean": _with("SELECT * FROM shown", "shown"),
    "normalized_text": _with("SELECT post_id, normalized FROM normal", "normal", base="posts"),
    "tokens": _with("SELECT post_id, array_to_string(words, ' ') AS words FROM words", "words", base="posts"),
    "token_bag": _with("SELECT post_id, array_to_string(bag, ',') AS bag FROM bags", "bags", base="posts"),
    "eligible_posts": _with("SELECT post_id, array_to_string(bag, ',') AS bag FROM eligible", "eligible", base="posts"),
    "raw_ingest": _with(f"""SELECT post_id, text, post_id % 1000 AS n_followers, CAST(1 AS BIGINT) AS n_friends
                           FROM posts WHERE length(text) >= {SHORT_LINE}""", "posts"),
    "raw_rejects": _with(f"""SELECT '{{"lang":"' || lang || '"' AS start, count(*) AS n FROM all_posts
                            WHERE length(text) < {SHORT_LINE} GROUP BY ALL""", "all_posts"),
    "sorted_lines": _with(f"""
        SELECT post_id, CASE WHEN post_id % 8 IN (0, 7) THEN 'post' ELSE 'reject' END AS kind,
               post_id % 8 IN (1, 2, 6) AS broken,
               CASE post_id % 8 WHEN 3 THEN 'lang' WHEN 4 THEN 'ts' WHEN 5 THEN 'n_friends' ELSE '' END AS missing
        FROM all_posts WHERE length(text) >= {SHORT_LINE} AND (lang = 'en' OR post_id % 8 IN (1, 2, 3, 6))""", "all_posts"),
    "entity_arrays": _with(f"""SELECT post_id, array_to_string(hashtags, ',') AS hashtags,
        array_to_string(users, ',') AS users, array_to_string(media_urls, ',') AS urls,
        array_to_string(media_urls, ',') AS media_urls FROM posts WHERE length(text) >= {SHORT_LINE}""", "posts"),
    "created_at_parse": _with(f"SELECT post_id, second FROM posts WHERE length(text) >= {SHORT_LINE}", "posts"),
    "aligned_windows": _with("""SELECT post_id, window_id, strftime(make_timestamp(window_id * 1000000),
        '%d-%m-%Y %H:%M') AS window_label FROM windowed""", "windowed"),
    "anchored_windows": _anchored_windows(),
    "anchored_events": _anchored_events(),
    "anchored_users": _anchored_users(),
    "window_sequence": _with("SELECT * FROM sequence", "sequence"),
    "window_stats": _with("""
        SELECT window_id, n_posts, coalesce(n_eligible, 0) AS n_eligible, coalesce(n_terms, 0) AS n_terms,
               coalesce(n_pruned_posts, 0) AS n_pruned_posts
        FROM (SELECT window_id, count(*) AS n_posts FROM windowed GROUP BY ALL)
        LEFT JOIN (SELECT window_id, count(*) AS n_eligible FROM eligible GROUP BY ALL) USING (window_id)
        LEFT JOIN (SELECT window_id, count(*) AS n_terms FROM vocab GROUP BY ALL) USING (window_id)
        LEFT JOIN (SELECT window_id, count(*) AS n_pruned_posts FROM pruned GROUP BY ALL) USING (window_id)""",
        "windowed", "eligible", "vocab", "pruned"),
    "anchored_window_stats": _with("""
        SELECT window_id, coalesce(n_posts, 0) AS n_posts, coalesce(n_eligible, 0) AS n_eligible,
               coalesce(n_terms, 0) AS n_terms, coalesce(n_pruned_posts, 0) AS n_pruned_posts
        FROM closed
        LEFT JOIN (SELECT window_id, count(*) AS n_posts FROM windowed GROUP BY ALL) USING (window_id)
        LEFT JOIN (SELECT window_id, count(*) AS n_eligible FROM eligible GROUP BY ALL) USING (window_id)
        LEFT JOIN (SELECT window_id, count(*) AS n_terms FROM vocab GROUP BY ALL) USING (window_id)
        LEFT JOIN (SELECT window_id, count(*) AS n_pruned_posts FROM pruned GROUP BY ALL) USING (window_id)""",
        "closed", "windowed", "eligible", "vocab", "pruned", over=_ANCHORED),
    "ngrams": _with("SELECT window_id, post_id, term FROM terms", "terms"),
    "min_df_vocabulary": _with("SELECT window_id, term, df FROM vocab", "vocab"),
    "pruned_posts": _with("SELECT window_id, post_id, terms FROM pruned", "pruned"),
    "copies": _with("SELECT window_id, pattern_id, n_posts FROM pats", "pats"),
    "term_df": _with("SELECT window_id, term, df FROM dfs", "dfs"),
    "history_mean": _with(f"SELECT window_id, term, df, {_millionths('avg_df', 'avg_df')} FROM history", "history"),
    "burst_weight": _with(f"SELECT window_id, term, {_millionths('weight', 'weight')} FROM weights", "weights"),
    "boosted_weight": _with(f"SELECT window_id, term, {_millionths('boosted', 'boosted')} FROM weights", "weights"),
    "top_terms": _with(f"""
        SELECT window_id, row_number() OVER (PARTITION BY window_id ORDER BY round(boosted, 9) DESC, term DESC) AS rank,
               term, {_millionths('round(boosted, 9)', 'boosted')} FROM weights
        QUALIFY rank <= {TOP_TERMS}""", "weights"),
    "distance_cut": _with(f"""SELECT window_id, {_millionths('max_distance', 'max_distance')},
        {_millionths('cut', 'cut')} FROM cuts""", "cuts"),
    "pair_cosine": _with(f"SELECT window_id, x, y, {_millionths('d', 'd')} FROM near", "near"),
    "near_pairs_wide": _with(f"SELECT window_id, x, y, {_millionths('d', 'd')} FROM near", "near",
                             over=_windows_of(WIDE.window_minutes)),
    "profile_distance": _with(f"""
        SELECT window_id, n.x, n.y, {_millionths('sqrt(sum((p.d - q.d) * (p.d - q.d)))', 'e')}
        FROM near n JOIN distances p USING (window_id) JOIN distances q USING (window_id)
        WHERE p.x = n.x AND q.x = n.y AND p.y = q.y GROUP BY window_id, n.x, n.y""", "near"),
    "post_clusters": _with("SELECT window_id, post_id, cluster_id FROM labels", "labels"),
    "post_clusters_wide": _with("SELECT window_id, post_id, cluster_id FROM labels", "labels",
                                over=_windows_of(WIDE.window_minutes)),
    "topic_sizes": _with(f"""
        SELECT window_id, topic, count(*) AS n_headlines, CAST(sum(size) AS BIGINT) AS n_posts,
               {_millionths('max(score)', 'score')},
               row_number() OVER (PARTITION BY window_id ORDER BY round(max(score), 9) DESC, min(first)) AS rank,
               row_number() OVER (PARTITION BY window_id ORDER BY round(max(score), 9) DESC, min(first)) <= {PARAMS.max_topics} AS listed
        FROM grouped GROUP BY window_id, topic""", "grouped"),
    "cluster_sizes": _with("SELECT window_id, cluster_id, size FROM sizes", "sizes"),
    "cluster_scores": _with(f"SELECT window_id, cluster_id, size, {_millionths('score', 'score')}, rank FROM scored",
                            "scored"),
    "cluster_headlines": _with("SELECT window_id, rank, post_id, array_to_string(bag, ',') AS bag FROM headlines",
                               "headlines"),
    "headline_cosine": _with(f"SELECT window_id, x, y, {_millionths('d', 'd')} FROM h_distances WHERE x < y",
                             "h_distances"),
    "headline_topics": _with("SELECT window_id, rank, topic FROM grouped", "grouped"),
    "topics": _with("SELECT * FROM topics", "topics"),
    "topic_lines": _with("SELECT window_label, headline, keywords, post_ids, media_urls FROM topics", "topics"),
}
# the rounds give what one task gives
ORACLE |= {"post_clusters_rounds": ORACLE["post_clusters"], "topics_rounds": ORACLE["topics"]}
