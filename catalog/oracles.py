"""DuckDB SQL for the queries: dense and literal, written from the meaning of each query."""

from __future__ import annotations

TOKEN = r"[\p{L}\p{N}_-]+"


def snap(expression: str, digits: int) -> str:
    return f"(round_even(({expression}) * 1e{digits}, 0) / 1e{digits})"


def r6(expression: str) -> str:
    return snap(expression, 6)


def q9(expression: str) -> str:
    return snap(expression, 9)


def top(source: str, k: int, key: str = "user_id") -> str:
    return (
        f"SELECT {key}, item_id, {r6('score')} AS score, rank FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY {key} ORDER BY score DESC, item_id) AS rank FROM {source}) WHERE rank <= {k}"
    )


CTES: dict[str, tuple[str, str]] = {}  # name -> (names it needs, body)


def cte(name: str, needs: str, body: str) -> None:
    CTES[name] = (needs, body)


def sql(needs: str, final: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in CTES[name][0].split():
            visit(other)
        order.append(name)

    for name in needs.split():
        visit(name)
    if not order:
        return final
    parts = ", ".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return f"WITH RECURSIVE {parts} {final}"


# ---- interaction views and splits, once per view -------------------------------------------

cte("clicks", "", """SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
    value, ts AS happened, event_type, event_id, event_id AS o1, 0 AS o2, 0 AS o3, 0 AS o4, 0 AS o5
    FROM events""")
cte("purchases", "", """SELECT o_custkey AS user_id, l_partkey AS item_id, l_quantity AS value,
    l_shipdate AS happened, l_orderkey, l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3,
    l_suppkey AS o4, l_quantity AS o5 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")


def holdout(source: str, keys: str, v: float, t: float) -> str:
    """Ratios 0.1 / 0.2 never need the reduction loop."""
    return f"""SELECT *, CASE WHEN n - rn < t THEN 'test' WHEN n - rn < t + v THEN 'validation'
        ELSE 'train' END AS split FROM (SELECT *,
        CASE WHEN n < 3 THEN 0 ELSE greatest(1, round_even(n * {v}::DOUBLE, 0)) END AS v,
        CASE WHEN n < 3 THEN 0 ELSE greatest(1, round_even(n * {t}::DOUBLE, 0)) END AS t
        FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n,
        row_number() OVER (PARTITION BY user_id ORDER BY {keys}) AS rn FROM {source}))"""


TIME_KEYS = "happened, o1, o2, o3, o4, o5"
for view, letter in (("clicks", "c"), ("purchases", "p")):
    cte(f"{letter}split", view, holdout(view, TIME_KEYS, 0.1, 0.2))
    cte(f"{letter}train", f"{letter}split", f"SELECT * FROM {letter}split WHERE split = 'train'")
    for part in ("train", "validation", "test"):
        cte(f"{letter}r_{part}", f"{letter}split", f"""SELECT user_id, item_id,
            sum(value) AS value FROM {letter}split WHERE split = '{part}' GROUP BY ALL""")
    cte(f"{letter}items", view, f"""SELECT item_id, row_number() OVER (ORDER BY item_id) AS pos
        FROM (SELECT DISTINCT item_id FROM {view})""")
    cte(f"{letter}users", view, f"SELECT DISTINCT user_id FROM {view}")
    cte(f"{letter}seen", f"{letter}r_train", f"""SELECT user_id, item_id FROM {letter}r_train
        WHERE value <> 0""")
    cte(f"{letter}pop", f"{letter}items {letter}r_train", f"""SELECT item_id, score, row_number()
        OVER (ORDER BY score DESC, item_id) AS pos FROM (SELECT i.item_id,
        coalesce({q9('sum(r.value)')}, 0) AS score FROM {letter}items i LEFT JOIN {letter}r_train r
        USING (item_id) GROUP BY 1)""")
    cte(f"{letter}ordered", f"{letter}train", f"""SELECT *, row_number() OVER (PARTITION BY user_id
        ORDER BY {TIME_KEYS}) AS pos FROM {letter}train""")
    cte(f"{letter}grid", f"{letter}users {letter}items", f"""SELECT user_id, item_id, pos
        FROM {letter}users, {letter}items""")
    cte(f"{letter}norm", f"{letter}r_train", f"""SELECT item_id, sqrt(sum(value * value)) AS norm
        FROM {letter}r_train GROUP BY 1""")
    cte(f"{letter}unit", f"{letter}r_train {letter}norm", f"""SELECT user_id, item_id,
        value / norm AS w FROM {letter}r_train JOIN {letter}norm USING (item_id) WHERE norm > 0""")
    for n in (10, 20):
        cte(f"{letter}knn{n}", f"{letter}unit", f"""SELECT * FROM (SELECT *, row_number() OVER
            (PARTITION BY item ORDER BY weight DESC, other) AS rank FROM (SELECT a.item_id AS item,
            b.item_id AS other, {q9('sum(a.w * b.w)')} AS weight FROM {letter}unit a
            JOIN {letter}unit b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY ALL)
            WHERE weight > 0) WHERE rank <= {n}""")
        cte(f"{letter}hist{n}", f"{letter}knn{n} {letter}r_train", f"""SELECT user_id,
            other AS item_id, {q9('sum(r.value * k.weight)')} AS score FROM {letter}r_train r
            JOIN {letter}knn{n} k ON r.item_id = k.item GROUP BY ALL""")

cte("pairs", "cordered", """SELECT item_id, next_item, count(*) AS n FROM (SELECT item_id,
    lead(item_id) OVER (PARTITION BY user_id ORDER BY pos) AS next_item FROM cordered)
    WHERE next_item IS NOT NULL GROUP BY ALL""")
cte("trans", "pairs", f"""SELECT item_id AS item, next_item AS other,
    {q9('n / sum(n) OVER (PARTITION BY item_id)')} AS weight FROM pairs""")
cte("lastc", "cordered", "SELECT user_id, arg_max(item_id, pos) AS item FROM cordered GROUP BY 1")
cte("markov_time", "cgrid cpop trans lastc", """SELECT g.user_id, g.item_id, CASE WHEN g.user_id IN
    (SELECT user_id FROM lastc JOIN trans USING (item)) THEN coalesce(t.weight, 0)
    ELSE p.score END AS score FROM cgrid g JOIN cpop p USING (item_id)
    LEFT JOIN lastc l ON g.user_id = l.user_id
    LEFT JOIN trans t ON t.item = l.item AND t.other = g.item_id""")
cte("dense", "cgrid cpop chist10 markov_time", """
    SELECT g.user_id, g.item_id, 'popularity' AS component, score FROM cgrid g JOIN cpop
    USING (item_id) UNION ALL
    SELECT g.user_id, g.item_id, 'itemknn', coalesce(h.score, 0) FROM cgrid g LEFT JOIN chist10 h
    USING (user_id, item_id) UNION ALL
    SELECT user_id, item_id, 'markov', score FROM markov_time""")
cte("ranked", "dense", """SELECT *, row_number() OVER (PARTITION BY user_id, component
    ORDER BY score DESC, item_id) AS rank FROM dense""")
cte("pdense", "pgrid ppop phist20", """
    SELECT g.user_id, g.item_id, 'popularity' AS component, score FROM pgrid g JOIN ppop
    USING (item_id) UNION ALL
    SELECT g.user_id, g.item_id, 'itemknn', coalesce(h.score, 0) FROM pgrid g LEFT JOIN phist20 h
    USING (user_id, item_id)""")
cte("pranked", "pdense", """SELECT *, row_number() OVER (PARTITION BY user_id, component
    ORDER BY score DESC, item_id) AS rank FROM pdense""")


def rrf(ranked: str, seen: str, where: str = "TRUE", constant: int = 60) -> str:
    return f"""SELECT user_id, item_id, {snap(f'sum(1.0::DOUBLE / ({constant} + rank))', 12)} AS score
        FROM {ranked} WHERE {where} AND (user_id, item_id) NOT IN (SELECT (user_id, item_id)
        FROM {seen}) GROUP BY ALL"""


def weighted(dense: str, seen: str, weight: str) -> str:
    return f"""SELECT user_id, item_id, {q9('sum(w * (score - m) / s)')} AS score FROM (SELECT *,
        {weight} AS w, avg(score) OVER p AS m, CASE WHEN stddev_pop(score) OVER p > 1e-9
        THEN stddev_pop(score) OVER p ELSE 1 END AS s FROM {dense}
        WINDOW p AS (PARTITION BY user_id, component))
        WHERE (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM {seen}) GROUP BY ALL"""


cte("rrf3", "ranked cseen", rrf("ranked", "cseen"))
cte("rrf2", "ranked cseen", rrf("ranked", "cseen", "component <> 'markov'"))
cte("rrf5", "ranked cseen", rrf("ranked", "cseen", "component <> 'markov'", 5))
cte("prrf", "pranked pseen", rrf("pranked", "pseen"))
cte("wz", "dense cseen", weighted("dense", "cseen", """CASE component WHEN 'popularity' THEN 0.5
    WHEN 'itemknn' THEN 2.0 ELSE 1.0 END"""))
cte("pwz", "pdense pseen", weighted("pdense", "pseen", "1.0"))
cte("pop_unseen", "pgrid ppop pseen", """SELECT g.user_id, g.item_id, score FROM pgrid g JOIN ppop
    USING (item_id) ANTI JOIN pseen s ON g.user_id = s.user_id AND g.item_id = s.item_id""")
cte("knn_unseen", "cgrid chist10 cseen", """SELECT g.user_id, g.item_id, coalesce(h.score, 0) AS score
    FROM cgrid g LEFT JOIN chist10 h USING (user_id, item_id)
    ANTI JOIN cseen s ON g.user_id = s.user_id AND g.item_id = s.item_id""")
cte("markov_unseen", "markov_time cseen", """SELECT m.* FROM markov_time m
    ANTI JOIN cseen s ON m.user_id = s.user_id AND m.item_id = s.item_id""")
cte("sessions", "cordered", """SELECT user_id AS request_id, latest - pos + 1 AS pos, item_id, value,
    CASE WHEN NOT (user_id % 3 = 0 AND pos = latest) THEN happened END AS happened FROM (SELECT
    user_id, pos, item_id, value, happened, max(pos) OVER (PARTITION BY user_id) AS latest
    FROM cordered)""")
cte("sorder", "sessions", """SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY
    CASE WHEN complete THEN epoch_us(happened) END, pos) AS rank FROM (SELECT *,
    bool_and(happened IS NOT NULL) OVER (PARTITION BY request_id) AS complete FROM sessions)""")
cte("svector", "sessions", """SELECT request_id, item_id, sum(value) AS value FROM sessions
    GROUP BY ALL""")
cte("sscores", "svector cknn10 citems", f"""SELECT request_id, i.item_id, coalesce(h.score, 0) AS score
    FROM (SELECT DISTINCT request_id FROM svector) r CROSS JOIN citems i LEFT JOIN (SELECT request_id,
    other AS item_id, {q9('sum(v.value * k.weight)')} AS score FROM svector v JOIN cknn10 k
    ON v.item_id = k.item GROUP BY ALL) h USING (request_id, item_id)""")
cte("sunseen", "sscores svector", """SELECT s.* FROM sscores s ANTI JOIN svector v ON
    s.request_id = v.request_id AND s.item_id = v.item_id AND v.value <> 0""")
cte("ccatalog", "clicks", """SELECT item_id, arg_max(event_type, event_id) AS event_type
    FROM clicks GROUP BY 1""")

# ---- text ------------------------------------------------------------------------------------

cte("pdocs", "", """SELECT p_partkey AS item_id, concat_ws(' ', p_name, p_type) AS doc,
    sha256(concat_ws(' ', p_name, p_type)) AS doc_key FROM part""")
cte("pterms", "pdocs", f"""SELECT doc_key, token, count(*) AS tf FROM (SELECT DISTINCT doc_key,
    doc FROM pdocs), unnest(regexp_extract_all(lower(doc), '{TOKEN}')) AS t(token) GROUP BY ALL""")
cte("pdf", "pterms pdocs", """SELECT token, count(*) AS df FROM pterms JOIN pdocs USING (doc_key)
    GROUP BY 1""")
cte("praw", "pterms pdf", """SELECT doc_key, token, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM part))
    / (1.0 + df)) + 1.0) AS raw FROM pterms JOIN pdf USING (token)""")
cte("pweights", "praw", """SELECT doc_key, token, raw / sqrt(sum(raw * raw) OVER
    (PARTITION BY doc_key)) AS weight FROM praw""")


def features(docs: str) -> str:
    return f"""SELECT doc_key, col, v / sqrt(sum(v * v) OVER (PARTITION BY doc_key)) AS weight FROM
        (SELECT doc_key, ('0x' || substr(sha256(token), 1, 8))::BIGINT % 128 AS col,
        CAST(sum(CASE WHEN ('0x' || substr(sha256(token), 9, 2))::BIGINT % 2 = 1 THEN 1 ELSE -1 END)
        AS DOUBLE) AS v FROM (SELECT DISTINCT doc_key, doc FROM {docs}),
        unnest(regexp_extract_all(lower(doc), '{TOKEN}')) AS t(token) GROUP BY ALL)
        WHERE v <> 0"""


def neighbours(docs: str, feats: str) -> str:
    return f"""SELECT item, other, {r6('weight')} AS weight, rank FROM (SELECT *, row_number() OVER
        (PARTITION BY item ORDER BY weight DESC, other) AS rank FROM (SELECT x.item_id AS item,
        y.item_id AS other, s.weight FROM (SELECT a.doc_key AS ka, b.doc_key AS kb,
        {q9('sum(a.weight * b.weight)')} AS weight FROM {feats} a JOIN {feats} b ON a.col = b.col
        GROUP BY ALL) s JOIN {docs} x ON x.doc_key = s.ka JOIN {docs} y ON y.doc_key = s.kb
        WHERE s.weight > 0 AND x.item_id <> y.item_id)) WHERE rank <= 10"""


cte("pfeat", "pdocs", features("pdocs"))
cte("ddocs", "", "SELECT doc_id AS item_id, text AS doc, sha256(text) AS doc_key FROM documents")
cte("dfeat", "ddocs", features("ddocs"))
cte("words", "", f"""SELECT token FROM documents,
    unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS t(token)""")
cte("vecs", "", "SELECT vec_id AS item, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings")
cte("vlong", "vecs", """SELECT item, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS dim
    FROM vecs""")
cte("dirty", "", "SELECT * FROM events")


def metrics(recommended: str, truth: str) -> str:
    return f"""SELECT {r6('avg(recall)')} AS recall, {r6('avg(ndcg)')} AS ndcg,
        count(*) AS evaluated_users FROM (SELECT t.user_id, count(r.item_id) / any_value(t.n) AS recall,
        coalesce(sum(1.0::DOUBLE / log2(r.rank + 1)), 0) / any_value(t.ideal) AS ndcg FROM
        (SELECT user_id, item_id, count(*) OVER (PARTITION BY user_id) AS n, (SELECT sum(1.0::DOUBLE
        / log2(p + 1)) FROM range(1, 11) x(p) WHERE p <= c) AS ideal FROM (SELECT *, count(*) OVER
        (PARTITION BY user_id) AS c FROM {truth})) t LEFT JOIN ({recommended}) r
        ON t.user_id = r.user_id AND t.item_id = r.item_id GROUP BY 1)"""


def propagated() -> str:
    """Layers written out: users and items as one node table with long-form vectors."""
    return "SELECT side, id, dim, " + r6("(x0 + coalesce(x1, 0) + coalesce(x2, 0)) / 3") + """ AS x
        FROM e0 LEFT JOIN e1 USING (side, id, dim) LEFT JOIN e2 USING (side, id, dim)"""


cte("deg", "cr_train", """SELECT user_id, item_id, 1.0::DOUBLE / sqrt(count(*) OVER (PARTITION BY
    user_id) * count(*) OVER (PARTITION BY item_id)) AS weight FROM cr_train""")
cte("arcs", "deg", """SELECT 'user' AS s, user_id AS a, 'item' AS t, item_id AS b, weight FROM deg
    UNION ALL SELECT 'item', item_id, 'user', user_id, weight FROM deg""")
cte("e0", "cusers citems", """SELECT side, id, d AS dim, ((id * (d + 3)) % 17) / 17 AS x0 FROM
    (SELECT 'user' AS side, user_id AS id FROM cusers UNION ALL SELECT 'item', item_id FROM citems),
    range(0, 4) r(d)""")
cte("e1", "e0 arcs", """SELECT s AS side, a AS id, dim, sum(weight * x0) AS x1 FROM arcs JOIN e0
    ON side = t AND id = b GROUP BY ALL""")
cte("e2", "e1 arcs", """SELECT s AS side, a AS id, dim, sum(weight * x1) AS x2 FROM arcs JOIN e1
    ON side = t AND id = b GROUP BY ALL""")
cte("counts", "purchases", "SELECT user_id, count(*) AS n FROM purchases GROUP BY 1")
cte("shrink", "counts", """SELECT user_id, n,
    CASE WHEN n < 3 THEN 0 ELSE CAST(greatest(1, round_even(n * 0.49::DOUBLE, 0)) AS BIGINT) END AS v,
    CASE WHEN n < 3 THEN 0 ELSE CAST(greatest(1, round_even(n * 0.5::DOUBLE, 0)) AS BIGINT) END AS t
    FROM counts UNION ALL
    SELECT user_id, n, CASE WHEN v >= t AND v > 0 THEN v - 1 ELSE v END,
    CASE WHEN v >= t AND v > 0 THEN t ELSE t - 1 END FROM shrink WHERE n >= 3 AND v + t >= n""")
cte("profile", "cr_train vecs", """SELECT user_id, dim, sum(value * x) / sum(abs(value)) AS p FROM
    (SELECT user_id, value, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM cr_train
    JOIN vecs ON item = item_id WHERE value <> 0) GROUP BY ALL""")
cte("profile_scores", "profile vecs", f"""SELECT user_id, item AS item_id, {q9('sum(p * x)')} AS score
    FROM profile JOIN (SELECT item, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM vecs)
    USING (dim) GROUP BY ALL""")
cte("docsim", "pweights", """SELECT a.doc_key AS ka, b.doc_key AS kb, sum(a.weight * b.weight) AS w
    FROM pweights a JOIN pweights b USING (token) GROUP BY ALL""")
cte("tfidf_scores", "pr_train docsim pdocs", f"""SELECT n.user_id, y.item_id,
    {q9('n.s - coalesce(r.value, 0)')} AS score FROM (SELECT user_id, kb, {q9('sum(value * w)')} AS s FROM (SELECT user_id,
    doc_key, sum(value) AS value FROM pr_train JOIN pdocs USING (item_id) GROUP BY ALL) JOIN docsim ON ka = doc_key GROUP BY ALL) n
    JOIN pdocs y ON y.doc_key = n.kb LEFT JOIN pr_train r ON r.user_id = n.user_id AND r.item_id = y.item_id""")
cte("last_scores", "sorder cknn10 citems svector", """SELECT l.request_id, i.item_id,
    coalesce(k.weight, 0) AS score FROM (SELECT request_id, arg_max(item_id, rank) AS item FROM sorder
    GROUP BY 1) l CROSS JOIN citems i LEFT JOIN cknn10 k ON k.item = l.item AND k.other = i.item_id
    ANTI JOIN svector v ON v.request_id = l.request_id AND v.item_id = i.item_id AND v.value <> 0""")
cte("reranked", "pop_unseen", f"""SELECT user_id, item_id,
    ((user_id * 31 + item_id * 17) % 101) / 100 AS score FROM ({top('pop_unseen', 10)})""")
cte("session_top3", "sunseen", top("sunseen", 3, "request_id"))

cte("munseen", "dense cseen", """SELECT d.*, row_number() OVER (PARTITION BY d.user_id, component
    ORDER BY score DESC, d.item_id) AS rank FROM dense d ANTI JOIN cseen s ON d.user_id = s.user_id
    AND d.item_id = s.item_id WHERE component <> 'markov'""")
cte("mpool", "munseen", "SELECT DISTINCT user_id, item_id FROM munseen WHERE rank <= 20")

cte("mfeat", "munseen mpool cr_validation", """SELECT m.user_id, m.item_id,
    max(score) FILTER (component = 'popularity') AS popularity_score,
    max(1.0::DOUBLE / (60 + rank)) FILTER (component = 'popularity') AS popularity_rr,
    max(score) FILTER (component = 'itemknn') AS itemknn_score,
    max(1.0::DOUBLE / (60 + rank)) FILTER (component = 'itemknn') AS itemknn_rr,
    CAST((m.user_id, m.item_id) IN (SELECT (user_id, item_id) FROM cr_validation) AS BIGINT) AS label
    FROM munseen m JOIN mpool USING (user_id, item_id)
    WHERE m.user_id IN (SELECT user_id FROM cr_validation) GROUP BY ALL""")
cte("mplace", "mfeat", """SELECT user_id, item_id, label, place, 1.0::DOUBLE / log2(place + 2) AS discount, (SELECT
    sum(1.0::DOUBLE / log2(p + 1)) FROM range(1, 31) x(p) WHERE p <= positives) AS ideal FROM (SELECT user_id,
    item_id, label, row_number() OVER (PARTITION BY user_id ORDER BY item_id) - 1 AS place,
    sum(label) OVER (PARTITION BY user_id) AS positives FROM mfeat)""")
cte("mpairs", "mplace", """SELECT a.user_id, a.item_id AS up, b.item_id AS down,
    abs(a.discount - b.discount) / a.ideal AS delta FROM mplace a JOIN mplace b ON a.user_id = b.user_id
    AND a.label = 1 AND b.label = 0 AND (a.place < 30 OR b.place < 30)""")
cte("mpulls", "mpairs", """SELECT user_id, up AS item_id, delta AS d FROM mpairs
    UNION ALL SELECT user_id, down, -delta FROM mpairs""")

def unit(part: int) -> str:
    return f"""(('0x' || substr(sha256('7|' || draw || '|{part}'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656"""


def below(part: int, limit: str) -> str:
    return f"CAST(least(floor({unit(part)} * ({limit})), ({limit}) - 1) AS BIGINT)"


cte("unodes", "cusers", """SELECT user_id, row_number() OVER (ORDER BY user_id) AS pos FROM cusers""")
cte("entries", "cr_train unodes citems", """SELECT -u.pos AS "user", i.pos AS item FROM cr_train
    JOIN unodes u USING (user_id) JOIN citems i USING (item_id)""")
cte("eligible", "entries citems", """SELECT *, row_number() OVER (ORDER BY -"user") AS spot FROM (SELECT "user",
    count(*) AS stored FROM entries GROUP BY 1) WHERE stored < (SELECT count(*) FROM citems)""")
cte("drawn", "entries eligible citems", f"""SELECT draw, "user", {below(1, 'stored')} + 1 AS spot,
    {below(2, '(SELECT count(*) FROM citems) - stored')} + 1 AS free FROM (SELECT draw,
    {below(0, '(SELECT count(*) FROM eligible)')} + 1 AS spot FROM (SELECT unnest(range((SELECT count(*) FROM cr_train)))
    AS draw)) JOIN eligible USING (spot)""")
cte("unseen", "entries citems", """SELECT "user", item, row_number() OVER (PARTITION BY "user" ORDER BY item) AS free
    FROM (SELECT DISTINCT "user" FROM entries) CROSS JOIN (SELECT pos AS item FROM citems)
    ANTI JOIN entries USING ("user", item)""")
cte("draws", "drawn entries unseen", """SELECT d.draw, d."user", p.item AS positive, n.item AS negative FROM drawn d
    JOIN (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY item) AS spot FROM entries) p
    ON d."user" = p."user" AND d.spot = p.spot JOIN unseen n ON d."user" = n."user" AND d.free = n.free""")
cte("given", "unodes citems", """SELECT node, d AS dim, (((node * (d + 3)) % 17 + 17) % 17) / 17 - 0.3 AS x FROM
    (SELECT -pos AS node FROM unodes UNION ALL SELECT pos FROM citems), range(0, 4) r(d)""")
cte("narcs", "entries", """SELECT unnest([{'n': "user", 'o': item}, {'n': item, 'o': "user"}], recursive := true), w FROM (SELECT "user",
    item, 1.0::DOUBLE / sqrt(count(*) OVER (PARTITION BY "user") * count(*) OVER (PARTITION BY item)) AS w FROM entries)""")


def spread(name: str, source: str) -> None:
    """Mean of layers 0 to 2 of a table (node, dim, x)."""
    layer = "SELECT n AS node, dim, sum(w * x) AS x FROM narcs JOIN {} ON o = node GROUP BY ALL"
    cte(f"{name}1", f"{source} narcs", layer.format(source))
    cte(f"{name}2", f"{name}1 narcs", layer.format(f"{name}1"))
    cte(name, f"{source} {name}1 {name}2", f"""SELECT node, dim, sum(x) / 3 AS x FROM (SELECT node, dim, x FROM {source}
        UNION ALL SELECT * FROM {name}1 UNION ALL SELECT * FROM {name}2) GROUP BY ALL""")


def pulled(name: str, vectors: str) -> None:
    """Gradient (node, dim, x) of the mean pairwise loss at a table of vectors."""
    cte(f"{name}_rows", f"draws {vectors}", f"""SELECT d.draw, "user", positive, negative, u.dim, u.x AS u, p.x AS p, n.x AS n,
        -1.0::DOUBLE / (1 + exp(sum(u.x * (p.x - n.x)) OVER (PARTITION BY d.draw))) / (SELECT count(*) FROM draws) AS c
        FROM draws d JOIN {vectors} u ON u.node = "user" JOIN {vectors} p ON p.node = positive AND p.dim = u.dim
        JOIN {vectors} n ON n.node = negative AND n.dim = u.dim""")
    cte(name, f"{name}_rows", f"""SELECT node, dim, sum(g) AS x FROM (SELECT "user" AS node, dim, c * (p - n) AS g FROM {name}_rows
        UNION ALL SELECT positive, dim, c * u FROM {name}_rows UNION ALL SELECT negative, dim, -c * u FROM {name}_rows) GROUP BY ALL""")


def cell(d: int) -> str:
    return f"((item_id * {d + 3}) % 17 / 17 - 0.4)"


cte("ae_a", "cr_train", f"""SELECT user_id, sum(value * {cell(0)}) / any_value(norm) AS a0, sum(value * {cell(1)}) / any_value(norm) AS a1
    FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY user_id)) AS norm FROM cr_train) GROUP BY 1""")
cte("ae_h", "ae_a", "SELECT user_id, tanh(a0 + 0.1) AS h0, tanh(a1 - 0.2) AS h1 FROM ae_a")
cte("ae_z", "ae_h", """SELECT user_id, 0.5::DOUBLE * h0 + 0.25::DOUBLE * h1 + 0.1 AS z0, -0.25::DOUBLE * h0 + 0.75::DOUBLE * h1 - 0.1 AS z1
    FROM ae_h""")
cte("ae_o", "ae_z", "SELECT user_id, tanh(z0 - 0.5::DOUBLE * z1 + 0.05) AS o0, tanh(0.5::DOUBLE * z0 + 0.25::DOUBLE * z1) AS o1 FROM ae_z")
cte("ae", "ae_o citems cseen", f"""SELECT user_id, item_id, {q9(f'o0 * {cell(0)} + o1 * {cell(1)} + {cell(2)}')} AS score
    FROM ae_o, citems WHERE (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM cseen)""")


def stepped(gradient: str) -> str:
    """First step of Adam: the gradient over its own size."""
    return f"""SELECT node, dim, {r6('s.x - 0.05::DOUBLE * coalesce(g.x / (abs(g.x) + 1e-8), 0)')} AS x
        FROM given s LEFT JOIN {gradient} g USING (node, dim)"""


pulled("bpr_g", "given")
spread("gcn_e", "given")
pulled("gcn_o", "gcn_e")
spread("gcn_b", "gcn_o")
cte("gcn_g", "gcn_b draws given", """SELECT node, dim, sum(x) AS x FROM (SELECT * FROM gcn_b UNION ALL
    SELECT node, dim, x * k * (2 * 0.01::DOUBLE / (SELECT count(*) FROM draws)) FROM given JOIN (SELECT node, count(*) AS k FROM
    (SELECT unnest(["user", positive, negative]) AS node FROM draws) GROUP BY 1) USING (node)) GROUP BY ALL""")

cte("uvec", "cusers citems", """SELECT user_id, item_id, CAST(sum(((user_id * (d + 3)) % 17 / 17 - 0.4) * ((item_id * (d + 3)) % 17 / 17 - 0.4))
    AS DOUBLE) AS score FROM cusers, citems, range(0, 4) r(d) GROUP BY ALL""")
cte("uvec_unseen", "uvec cseen", f"""SELECT user_id, item_id, {q9('score')} AS score FROM uvec
    ANTI JOIN cseen s ON uvec.user_id = s.user_id AND uvec.item_id = s.item_id""")
cte("mixed", "markov_time cseen", """SELECT * FROM (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id
    ORDER BY score DESC, item_id) AS rank FROM markov_time m WHERE user_id % 17 <> 0 AND NOT (user_id % 2 = 0
    AND (user_id, item_id) IN (SELECT (user_id, item_id) FROM cseen))) WHERE rank <= user_id % 10 + 1""")
REQUESTS = sql("mixed cusers cseen", f"""SELECT CAST(u.user_id AS VARCHAR) AS request_id, CASE WHEN u.user_id % 17 = 0 OR u.user_id % 3 = 0
    THEN 'known_user' ELSE 'history' END AS mode, CASE WHEN u.user_id % 17 = 0 THEN 'unknown_identifier' ELSE 'ok' END AS status,
    coalesce(item_id, -1) AS item_id, coalesce({r6('score')}, -1) AS score, coalesce(rank, 0) AS rank FROM (SELECT DISTINCT user_id FROM cseen) u LEFT JOIN mixed USING (user_id)""")
for turn, cond in ((0, "(user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM cseen)"), (1, "TRUE")):
    cte(f"turn{turn}", "markov_time cseen", f"""SELECT user_id * 2 + {turn} AS request_id, user_id % 5 + 1 AS deep, item_id, score
        FROM markov_time WHERE {cond}""")
cte("turns", "turn0 turn1", "SELECT * FROM turn0 UNION ALL SELECT * FROM turn1")
EXPORTED = sql("clicks", f"SELECT user_id, item_id, {r6('value')} AS value, CAST(floor(epoch_us(happened) / 1000000) AS BIGINT) AS t FROM clicks")

ORACLES: dict[str, str] = {
    "pair_draws": sql("draws", """SELECT 0::BIGINT AS step, "user", positive, negative FROM draws"""),
    "bpr_one_step": sql("given bpr_g", stepped("bpr_g")),
    "lightgcn_one_step": sql("given gcn_g", stepped("gcn_g")),
    "scan_csv": f"SELECT event_id, user_id, event_type, props, {r6('value')} AS value FROM events",
    "scan_movielens_csv": EXPORTED,
    "scan_movielens_dat": EXPORTED,
    "scan_yelp_json": EXPORTED,
    "adapter_row_order": "SELECT event_id, row_number() OVER () AS place FROM events",
    "prepared_round_trip": sql("csplit", "SELECT event_id, user_id, split FROM csplit"),
    "model_round_trip": sql("cknn10", f"SELECT item, other, {r6('weight')} AS weight FROM cknn10"),
    "model_description": sql("citems", """SELECT 'itemknn' AS plugin, 'sparse' AS runtime, 'history' AS capabilities,
        count(*) AS catalog_size FROM citems"""),
    "payload_violations": sql("cknn10", """SELECT * FROM (SELECT 'itemknn.non_finite' AS name, count(*) AS n FROM cknn10
        WHERE item % 7 = 0 UNION ALL SELECT 'itemknn.unknown_other', count(*) FROM cknn10 WHERE other % 11 = 0) WHERE n > 0"""),
    "evaluate_hybrid": sql("rrf2 cr_test", metrics(top("rrf2", 10), "cr_test")),
    "run_metrics": sql("rrf2 cr_test", metrics(top("rrf2", 10), "cr_test")),
    "recommend_requests": REQUESTS,
    "stream_requests": REQUESTS,
    "score_autoencoder": sql("ae", top("ae", 10)),
    "score_embedding_user": sql("uvec_unseen", top("uvec_unseen", 10)),
    "user_requests": sql("turns", f"""SELECT request_id, item_id, {r6('score')} AS score, rank FROM (SELECT *, row_number() OVER
        (PARTITION BY request_id ORDER BY score DESC, item_id) AS rank FROM turns) WHERE rank <= deep"""),
    "lambda_gradients": sql("mplace mpulls", f"""SELECT m.user_id, m.item_id, {r6('coalesce(sum(d), 0) / 2')} AS g,
        {r6('coalesce(sum(abs(d)), 0) / 4')} AS h FROM mplace m LEFT JOIN mpulls p
        ON m.user_id = p.user_id AND m.item_id = p.item_id GROUP BY ALL"""),
    "tree_scores": sql("mfeat", """SELECT user_id, item_id, 0.25::DOUBLE * CASE WHEN itemknn_rr <= 0.0148
        THEN CASE WHEN popularity_score <= 33.33333 THEN -1.0 ELSE 0.125 END ELSE 0.75 END + 0.25::DOUBLE * CASE
        WHEN popularity_rr <= 0.0142 THEN -0.5 WHEN itemknn_score <= 5.12345 THEN 0.25 ELSE 1.5 END AS score
        FROM mfeat"""),
    "fusion_training_set": sql("munseen mpool cr_validation", f"""SELECT m.user_id, m.item_id,
        {r6("max(score) FILTER (component = 'popularity')")} AS popularity_score,
        {q9("max(1.0::DOUBLE / (60 + rank)) FILTER (component = 'popularity')")} AS popularity_rr,
        {r6("max(score) FILTER (component = 'itemknn')")} AS itemknn_score,
        {q9("max(1.0::DOUBLE / (60 + rank)) FILTER (component = 'itemknn')")} AS itemknn_rr,
        CAST((m.user_id, m.item_id) IN (SELECT (user_id, item_id) FROM cr_validation) AS BIGINT) AS label
        FROM munseen m JOIN mpool USING (user_id, item_id)
        WHERE m.user_id IN (SELECT user_id FROM cr_validation) GROUP BY ALL"""),
    "pair_samples": sql("cr_train", """SELECT (SELECT count(*) FROM cr_train) AS draws,
        (SELECT count(*) FROM cr_train) AS stored_positives, 0::BIGINT AS stored_negatives,
        count(*) AS users FROM (SELECT user_id FROM cr_train GROUP BY 1)"""),
    "normalize_purchases": sql("purchases", """SELECT user_id, item_id, value, epoch_us(happened) AS ts_us,
        l_orderkey FROM purchases"""),
    "normalize_clicks": sql("clicks", """SELECT user_id, item_id, value, epoch_us(happened) AS ts_us,
        event_type, event_id FROM clicks"""),
    "violation_counts": """SELECT count(*) AS "rows", count(*) FILTER (user_id % 50 = 0) AS bad_user_id,
        count(*) FILTER (event_id % 97 = 0) AS bad_item_id, count(*) FILTER (value > 30) AS bad_value,
        count(*) FILTER (event_id % 11 = 0) AS bad_timestamp FROM events""",
    "catalog_last_row": sql("ccatalog", "SELECT * FROM ccatalog"),
    "dense_index_items": sql("pitems", "SELECT * FROM pitems"),
    "dataset_profile": sql("purchases", """SELECT count(DISTINCT user_id) AS users,
        count(DISTINCT item_id) AS items, count(*) AS events FROM purchases"""),
    "typed_identifiers": """SELECT encoded, int_id, text_id, dense_rank() OVER (ORDER BY kind, int_id,
        text_id) AS pos FROM (SELECT '{"type":"integer","value":' || c_custkey || '}' AS encoded,
        0 AS kind, c_custkey AS int_id, '' AS text_id FROM customer UNION ALL
        SELECT '{"type":"string","value":"' || c_name || '"}', 1, -1, c_name FROM customer)""",
    "metadata_cleanup": """SELECT p_partkey, p_name, CASE WHEN p_size % 7 <> 0 AND p_size % 5 <> 0
        THEN p_retailprice END AS p_retailprice FROM part""",
    "item_documents": """SELECT p_partkey, CASE WHEN p_size > 40 THEN p_name || ' ' || p_brand
        WHEN p_size > 25 THEN p_name ELSE CAST(p_partkey AS VARCHAR) END AS doc FROM part""",
    "document_tokens": sql("words", "SELECT token, count(*) AS n FROM words GROUP BY 1"),
    "token_hash_features": sql("words", """SELECT token,
        ('0x' || substr(sha256(token), 1, 8))::BIGINT % 128 AS col,
        CASE WHEN ('0x' || substr(sha256(token), 9, 2))::BIGINT % 2 = 1 THEN 1.0::DOUBLE
        ELSE -1.0::DOUBLE END AS sign FROM (SELECT DISTINCT token FROM words)"""),
    "normalized_vectors": sql("vlong", f"""SELECT item, dim, {r6('x / sqrt(sum(x * x) OVER (PARTITION BY item))')}
        AS x FROM vlong"""),
    "holdout_counts": sql("shrink", """SELECT user_id, n, v AS n_validation, t AS n_test FROM shrink
        WHERE n < 3 OR v + t < n"""),
    "split_temporal": sql("csplit", "SELECT event_id, user_id, split FROM csplit"),
    "split_seeded": sql("clicks", f"""SELECT event_id, user_id, split FROM ({holdout('clicks',
        "sha256('42|' || user_id || '|' || event_id), event_id", 0.1, 0.2)})"""),
    "split_integrity": """SELECT 0::BIGINT AS missing_rows, 0::BIGINT AS foreign_rows,
        count(*) - count(DISTINCT event_id) AS repeated_rows FROM events""",
    "ratings_train": sql("pr_train", f"SELECT user_id, item_id, {r6('value')} AS value FROM pr_train"),
    "ordered_events": sql("cordered", "SELECT user_id, pos, event_id, item_id FROM cordered"),
    "item_sequences": sql("cordered", "SELECT user_id, pos, item_id FROM cordered"),
    "recent_items": sql("cordered", """SELECT user_id, slot, coalesce(item_id, -1) AS item_id FROM
        (SELECT user_id, max(pos) AS n FROM cordered GROUP BY 1) u CROSS JOIN range(0, 20) s(slot)
        LEFT JOIN (SELECT user_id, pos, item_id FROM cordered) c USING (user_id)
        WHERE c.pos = n - 19 + slot UNION ALL SELECT user_id, slot, -1 FROM (SELECT user_id,
        max(pos) AS n FROM cordered GROUP BY 1) CROSS JOIN range(0, 20) s(slot)
        WHERE n - 19 + slot < 1"""),
    "transition_pairs": sql("pairs", "SELECT * FROM pairs"),
    "last_item": sql("lastc", "SELECT user_id, item AS item_id FROM lastc"),
    "prefix_examples": sql("cordered", """SELECT user_id, pos, repeat('-1,', 8 - len(p)) ||
        array_to_string(p, ',') AS prefix, item_id AS target FROM (SELECT *, list(item_id) OVER
        (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS p
        FROM cordered) WHERE pos > 1"""),
    "request_order": sql("sorder", "SELECT request_id, pos, item_id, rank FROM sorder"),
    "popularity": sql("ppop", f"SELECT item_id, {r6('score')} AS score, pos FROM ppop"),
    "item_norms": sql("pnorm", f"SELECT item_id, {r6('norm')} AS norm FROM pnorm"),
    "itemknn_topn": sql("pknn20", f"SELECT item, other, {r6('weight')} AS weight, rank FROM pknn20"),
    "cooccurrence_min2": sql("pr_train", """SELECT a.item_id AS item, b.item_id AS other,
        CAST(count(*) AS DOUBLE) AS weight FROM pr_train a JOIN pr_train b ON a.user_id = b.user_id
        AND a.item_id <> b.item_id GROUP BY ALL HAVING count(*) >= 2"""),
    "markov_transitions": sql("pairs", f"""SELECT item_id, next_item AS other,
        {r6('n / sum(n) OVER (PARTITION BY item_id)')} AS weight FROM pairs"""),
    "tfidf_weights": sql("pweights", f"SELECT doc_key, token, {r6('weight')} AS weight FROM pweights"),
    "tfidf_similarity": sql("pweights", f"""SELECT a.doc_key AS item, b.doc_key AS other,
        {r6('sum(a.weight * b.weight)')} AS weight FROM pweights a JOIN pweights b
        ON a.token = b.token AND a.doc_key <> b.doc_key GROUP BY ALL"""),
    "hashed_features": sql("dfeat", f"SELECT doc_key, col, {r6('weight')} AS weight FROM dfeat"),
    "semantic_topn": sql("pfeat", neighbours("pdocs", "pfeat")),
    "semantic_topn_documents": sql("dfeat", neighbours("ddocs", "dfeat")),
    "embedding_topn": sql("vecs", f"""SELECT item, other, {r6('weight')} AS weight, rank FROM (SELECT *,
        row_number() OVER (PARTITION BY item ORDER BY weight DESC, other) AS rank FROM (SELECT
        a.item, b.item AS other, {q9('list_dot_product(a.vec, b.vec)')} AS weight FROM vecs a JOIN vecs b
        ON a.item <> b.item) WHERE weight > 0) WHERE rank <= 10"""),
    "score_popularity": sql("pop_unseen", top("pop_unseen", 10)),
    "score_itemknn": sql("phist20", f"""SELECT user_id, item_id, {r6('score')} AS score FROM phist20
        WHERE score <> 0"""),
    "score_last_item": sql("last_scores", top("last_scores", 10, "request_id")),
    "score_markov_fallback": sql("markov_unseen", top("markov_unseen", 10)),
    "score_embedding_profile": sql("profile_scores", top("profile_scores", 10)),
    "score_tfidf_factored": sql("tfidf_scores", top("tfidf_scores", 10)),
    "component_ranks": sql("ranked cr_test", f"""SELECT user_id, item_id, component,
        {r6('score')} AS score, rank FROM ranked JOIN cr_test USING (user_id, item_id)"""),
    "rrf": sql("rrf3", top("rrf3", 10)),
    "rrf_constant_5": sql("rrf5", top("rrf5", 10)),
    "rrf_purchases": sql("prrf", top("prrf", 10)),
    "weighted_zscore": sql("wz", top("wz", 10)),
    "weighted_purchases": sql("pwz", top("pwz", 10)),
    "hybrid_top10": sql("rrf2", top("rrf2", 10)),
    "candidate_pool": sql("dense cseen", """SELECT DISTINCT user_id, item_id FROM (SELECT *,
        row_number() OVER (PARTITION BY user_id, component ORDER BY score DESC, item_id) AS rank
        FROM dense d ANTI JOIN cseen s ON d.user_id = s.user_id AND d.item_id = s.item_id)
        WHERE rank <= 10"""),
    "recommend_users": sql("markov_unseen ccatalog", f"""SELECT r.*, c.event_type FROM
        ({top('markov_unseen', 10)}) r JOIN ccatalog c USING (item_id)"""),
    "recommend_sessions": sql("sunseen sscores", f"""SELECT * FROM (SELECT * FROM
        ({top('sunseen', 10, 'request_id')}) WHERE request_id % 2 = 0 UNION ALL SELECT * FROM
        ({top('sscores', 10, 'request_id')}) WHERE request_id % 2 <> 0)
        WHERE rank <= request_id % 10 + 1"""),
    "recommend_include_seen": sql("cgrid chist10", top("""(SELECT g.user_id, g.item_id,
        coalesce(h.score, 0) AS score FROM cgrid g LEFT JOIN chist10 h USING (user_id, item_id))""", 10)),
    "request_status": sql("sessions cusers citems", """SELECT request_id, CASE WHEN user_id IS NOT NULL
        THEN 'known_user' ELSE 'history' END AS mode, CASE
        WHEN (user_id IS NOT NULL) = (n > 0) THEN 'invalid_request'
        WHEN top_k > 1000 THEN 'invalid_request'
        WHEN user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM cusers) THEN 'unknown_identifier'
        WHEN user_id IS NULL AND unknown > 0 THEN 'unknown_identifier' ELSE 'ok' END AS status
        FROM (SELECT request_id, CASE WHEN request_id % 10 = 0 THEN request_id
        WHEN request_id % 15 = 0 THEN 999999 WHEN request_id % 11 = 0 THEN request_id END AS user_id,
        CASE WHEN request_id % 13 = 0 THEN 1001 ELSE 10 END AS top_k,
        count(*) FILTER (request_id % 5 <> 0) AS n,
        count(*) FILTER (request_id % 5 <> 0 AND (request_id % 7 = 0 OR item_id NOT IN
        (SELECT item_id FROM citems))) AS unknown FROM sessions GROUP BY request_id)"""),
    "rerank_external": sql("reranked", top("reranked", 5)),
    "prompt_table": sql("session_top3 sorder ccatalog", """SELECT t.request_id, t.item_id, 'H:[' ||
        h.lines || '] C:{"event_type":"' || c.event_type || '"}' AS prompt FROM session_top3 t
        JOIN ccatalog c USING (item_id) JOIN (SELECT request_id, string_agg('{"item_id":' || item_id ||
        ',"value":' || value || ',"metadata":{"event_type":"' || event_type || '"}}', ', ' ORDER BY rank) AS lines
        FROM sorder JOIN ccatalog USING (item_id) GROUP BY 1) h USING (request_id)"""),
    "metrics_popularity": sql("pop_unseen pr_test", metrics(top("pop_unseen", 10), "pr_test")),
    "metrics_itemknn": sql("knn_unseen cr_test", metrics(top("knn_unseen", 10), "cr_test")),
    "metrics_hybrid": sql("rrf2 cr_test", metrics(top("rrf2", 10), "cr_test")),
    "normalized_edges": sql("pr_train", f"""SELECT user_id, item_id, {r6('''1.0::DOUBLE / sqrt(count(*)
        OVER (PARTITION BY user_id) * count(*) OVER (PARTITION BY item_id))''')} AS weight FROM pr_train"""),
    "propagate_2_layers": sql("e0 e1 e2", propagated()),
}
