"""SQL for the registered queries, as ANSI as the tables allow."""

from __future__ import annotations

CUTOFF = "DATE '2001-02-01'"
BRAND = "CAST(substr(p_brand, 7) AS BIGINT)"


def base(universe: str = "brand") -> str:
    """tx, ui, stats and bi: transactions, training counts, item statistics, known items of test baskets."""
    item, join = (BRAND, "JOIN part ON l_partkey = p_partkey") if universe == "brand" else ("l_partkey", "")
    return f"""tx AS (SELECT o_custkey AS customer, {item} AS item, o_orderkey AS basket, CAST(o_orderdate AS DATE) AS day
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey {join}),
ui AS (SELECT customer, item, CAST(count(*) AS DOUBLE) AS w FROM tx WHERE day < {CUTOFF} GROUP BY customer, item),
stats AS (SELECT item, sum(w) AS pop, sum(w) / (SELECT sum(w) FROM ui) AS prior, count(*) AS users FROM ui GROUP BY item),
bi AS (SELECT DISTINCT basket, item FROM tx WHERE day >= {CUTOFF} AND item IN (SELECT item FROM ui))"""


NUI = "nui AS (SELECT u.customer, u.item, u.w / r.s AS w FROM ui u JOIN (SELECT customer, sum(w) AS s FROM ui GROUP BY customer) r ON u.customer = r.customer)"
COOC = "edges AS (SELECT a.item AS src, b.item AS dst, sum(a.w * b.w) AS w FROM ui a JOIN ui b ON a.customer = b.customer WHERE a.item <> b.item GROUP BY a.item, b.item)"
COOC_ALL = COOC.replace(" WHERE a.item <> b.item", "").replace("edges AS", "dense AS")
TRANS = NUI + """,
t AS (SELECT a.item AS src, b.item AS dst, sum(a.w * b.w / s.pop) AS w FROM nui a JOIN ui b ON a.customer = b.customer JOIN stats s ON s.item = b.item WHERE a.item <> b.item GROUP BY a.item, b.item)"""
PROB = "p AS (SELECT e.src, e.dst, e.w / r.s AS w FROM edges e JOIN (SELECT src, sum(w) AS s FROM edges GROUP BY src) r ON e.src = r.src)"
COND = "edges AS (SELECT a.item AS src, b.item AS dst, count(*) / (max(x.users) * pow(max(y.users), 0.5)) AS w FROM ui a JOIN ui b ON a.customer = b.customer JOIN stats x ON x.item = a.item JOIN stats y ON y.item = b.item GROUP BY a.item, b.item)"


def scored(evidence: str = "bi", edges: str = "edges") -> str:
    """scores: additive, without evidence."""
    return f"""raw AS (SELECT b.basket, e.dst AS item, sum(e.w) AS score FROM {evidence} b JOIN {edges} e ON b.item = e.src GROUP BY b.basket, e.dst),
scores AS (SELECT r.* FROM raw r LEFT JOIN {evidence} b ON r.basket = b.basket AND r.item = b.item WHERE b.item IS NULL)"""


def top(n: int, scores: str = "scores", name: str = "best") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT basket, item, score, row_number() OVER (PARTITION BY basket ORDER BY round(score, 9) DESC, item DESC) AS rank FROM {scores} WHERE round(score, 9) > 0) q WHERE rank <= {n})"""


NOVEL = """least AS (SELECT b.basket, min(s.pop) AS least FROM {e} b JOIN stats s ON b.item = s.item GROUP BY b.basket),
fresh AS (SELECT x.basket, x.item, x.score FROM scores x JOIN stats s ON x.item = s.item JOIN least l ON x.basket = l.basket WHERE s.pop < l.least)"""
RECO = "SELECT basket, item, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM best"


def q(*parts: str) -> str:
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def eligible(n: int) -> str:
    return f"el AS (SELECT bi.* FROM bi JOIN (SELECT basket, count(*) AS k FROM bi GROUP BY basket) c ON bi.basket = c.basket WHERE k >= {n + 1})"


def hidden(order: str, n: int) -> str:
    return f"""goal AS (SELECT basket, item FROM (SELECT el.basket, el.item, row_number() OVER (PARTITION BY el.basket ORDER BY {order}) AS r FROM el JOIN stats s ON el.item = s.item) z WHERE r <= {n}),
ev AS (SELECT el.* FROM el LEFT JOIN goal g ON el.basket = g.basket AND el.item = g.item WHERE g.item IS NULL)"""


def hit(name: str) -> str:
    return f"{name} AS (SELECT a.basket, CASE WHEN h.basket IS NULL THEN 0.0 ELSE 1.0 END AS value FROM (SELECT DISTINCT basket FROM el) a LEFT JOIN (SELECT DISTINCT b.basket FROM best b JOIN goal g ON b.basket = g.basket AND b.item = g.item) h ON a.basket = h.basket)"


SHUFFLE = "(el.item * 2654435761 + el.basket * 40503) % 1000003, el.item"


def pop_hit(n: int) -> str:
    return q(base(), COOC, eligible(n), hidden("s.pop, el.item", n), scored("ev"), NOVEL.format(e="ev"), top(n, "fresh"), hit("m"), "SELECT basket, CAST(value AS DOUBLE) AS value FROM m")


def rnd_hit(n: int) -> str:
    return q(base(), COOC, eligible(n), hidden(SHUFFLE, n), scored("ev"), top(n), hit("m"), "SELECT basket, CAST(value AS DOUBLE) AS value FROM m")


def whr(n: int) -> str:
    return q(base(), COOC, eligible(n), """parts AS (SELECT a.basket, a.item AS hid, b.item FROM el a JOIN el b ON a.basket = b.basket WHERE a.item <> b.item),
raw AS (SELECT p.basket, p.hid, e.dst AS item, sum(e.w) AS score FROM parts p JOIN edges e ON p.item = e.src GROUP BY p.basket, p.hid, e.dst),
scores AS (SELECT r.* FROM raw r LEFT JOIN parts p ON r.basket = p.basket AND r.hid = p.hid AND r.item = p.item WHERE p.item IS NULL),
best AS (SELECT * FROM (SELECT basket, hid, item, row_number() OVER (PARTITION BY basket, hid ORDER BY round(score, 9) DESC, item DESC) AS rank FROM scores WHERE round(score, 9) > 0) z WHERE rank <= """ + str(n) + """)""",
        "SELECT el.basket, round(sum((1 - s.prior) * CASE WHEN b.item IS NULL THEN 0.0 ELSE 1.0 END) / sum(1 - s.prior), 6) AS value FROM el JOIN stats s ON el.item = s.item LEFT JOIN best b ON el.basket = b.basket AND el.item = b.hid AND b.item = b.hid GROUP BY el.basket")


def novelty(n: int) -> str:
    return q(base(), COOC, eligible(n), hidden("s.pop, el.item", n), scored("ev"), top(n), "m AS (SELECT avg(prior) AS m FROM (SELECT prior FROM stats ORDER BY prior DESC, item DESC LIMIT 10) z)",
        "SELECT a.basket, round(coalesce(v.value, 0.0), 6) AS value FROM (SELECT DISTINCT basket FROM el) a LEFT JOIN (SELECT b.basket, avg((m.m - s.prior) / m.m) AS value FROM best b JOIN stats s ON b.item = s.item CROSS JOIN m GROUP BY b.basket) v ON a.basket = v.basket")


def walk(start: str, edges: str, alpha: float, steps: int, back: bool = False) -> str:
    """s<steps>: (id, item, s) from ``start``; ``back`` goes against the direction of the edges."""
    a, b = ("dst", "src") if back else ("src", "dst")
    out = [f"s1 AS (SELECT id, item, s * {1 - alpha} AS s FROM {start})"]
    for k in range(2, steps + 1):
        out.append(f"s{k} AS (SELECT id, item, sum(s) AS s FROM (SELECT m.id, e.{b} AS item, {alpha} * m.s * e.w AS s FROM s{k - 1} m JOIN {edges} e ON m.item = e.{a} UNION ALL SELECT id, item, s * {1 - alpha} AS s FROM {start}) z GROUP BY id, item)")
    return ",\n".join(out)


EACH = "each_item AS (SELECT item AS id, item, CAST(1.0 AS DOUBLE) AS s FROM stats)"


def summed(steps: int) -> str:
    """Scores of baskets from walks that start at each item, evidence left out, three best."""
    return f"raw AS (SELECT b.basket, m.item, sum(m.s) AS score FROM bi b JOIN s{steps} m ON b.item = m.id GROUP BY b.basket, m.item),\nscores AS (SELECT r.* FROM raw r LEFT JOIN bi b ON r.basket = b.basket AND r.item = b.item WHERE b.item IS NULL)"


def biased(theta: float, steps: int) -> str:
    out = [f"w AS (SELECT p.src, p.dst, p.w * exp(-{theta} * s.prior / (SELECT avg(prior) FROM stats)) AS w FROM p JOIN stats s ON p.dst = s.item)", "v0 AS (SELECT item, CAST(1.0 AS DOUBLE) AS v FROM stats)"]
    for k in range(1, steps + 1):
        out += [f"x{k} AS (SELECT w.src AS item, sum(w.w * v.v) AS v FROM w JOIN v{k - 1} v ON w.dst = v.item GROUP BY w.src)", f"v{k} AS (SELECT item, v / (SELECT max(v) FROM x{k}) AS v FROM x{k})"]
    out += [f"y AS (SELECT w.src, w.dst, w.w * v.v AS w FROM w JOIN v{steps} v ON w.dst = v.item)", "bp AS (SELECT y.src, y.dst, y.w / r.s AS w FROM y JOIN (SELECT src, sum(w) AS s FROM y GROUP BY src) r ON y.src = r.src)"]
    return ",\n".join(out)


def paths(alpha: float, theta: float, steps: int) -> str:
    out = [f"w AS (SELECT t.src, t.dst, t.w * {alpha} * exp(-{theta} * s.prior / (SELECT max(prior) FROM stats)) AS w FROM t JOIN stats s ON t.dst = s.item)",
        "f1 AS (SELECT b.basket, w.dst AS item, sum(w.w) AS s FROM bi b JOIN w ON b.item = w.src GROUP BY b.basket, w.dst)", "b1 AS (SELECT basket, item, CAST(1.0 AS DOUBLE) AS s FROM bi)"]
    for k in range(2, steps + 1):
        out += [f"f{k} AS (SELECT f.basket, w.dst AS item, sum(f.s * w.w) AS s FROM f{k - 1} f JOIN w ON f.item = w.src LEFT JOIN bi e ON f.basket = e.basket AND f.item = e.item WHERE e.item IS NULL GROUP BY f.basket, w.dst)",
            f"b{k} AS (SELECT f.basket, w.src AS item, sum(f.s * w.w) AS s FROM b{k - 1} f JOIN w ON f.item = w.dst LEFT JOIN bi e ON f.basket = e.basket AND w.src = e.item WHERE e.item IS NULL GROUP BY f.basket, w.src)"]
    union = lambda x: " UNION ALL ".join(f"SELECT basket, item, s FROM {x}{k}" for k in range(1, steps + 1))
    out += [f"zf AS (SELECT basket, item, sum(s) AS s FROM ({union('f')}) u GROUP BY basket, item)", f"zb AS (SELECT basket, item, sum(s) AS s FROM ({union('b')}) u GROUP BY basket, item)",
        "z AS (SELECT f1.basket, sum(f1.s * zb.s) AS z FROM f1 JOIN zb ON f1.basket = zb.basket AND f1.item = zb.item GROUP BY f1.basket)"]
    return ",\n".join(out)


def plsa(topics: int, steps: int) -> str:
    zs = "(SELECT CAST(z AS INTEGER) AS z FROM (VALUES " + ", ".join(f"({z})" for z in range(topics)) + ") t(z))"
    out = [f"w0 AS (SELECT item, z, p / sum(p) OVER (PARTITION BY z) AS p FROM (SELECT item, z, CAST(1 + (item * 31 + z * 17) % 7 AS DOUBLE) AS p FROM stats CROSS JOIN {zs} zz) a)",
        f"d0 AS (SELECT customer, z, p / sum(p) OVER (PARTITION BY z) AS p FROM (SELECT customer, z, CAST(1 + (customer * 13 + z * 29) % 11 AS DOUBLE) AS p FROM (SELECT DISTINCT customer FROM ui) c CROSS JOIN {zs} zz) a)",
        f"z0 AS (SELECT z, CAST({1 / topics!r} AS DOUBLE) AS p FROM {zs} zz)"]
    for k in range(1, steps + 1):
        j = k - 1
        out += [f"n{k} AS (SELECT customer, item, z, w * q / sum(q) OVER (PARTITION BY customer, item) AS p FROM (SELECT u.customer, u.item, u.w, a.z, c.p * a.p * b.p AS q FROM ui u JOIN w{j} a ON u.item = a.item JOIN d{j} b ON u.customer = b.customer AND a.z = b.z JOIN z{j} c ON a.z = c.z) x)",
            f"w{k} AS (SELECT item, z, p / sum(p) OVER (PARTITION BY z) AS p FROM (SELECT item, z, sum(p) AS p FROM n{k} GROUP BY item, z) x)",
            f"d{k} AS (SELECT customer, z, p / sum(p) OVER (PARTITION BY z) AS p FROM (SELECT customer, z, sum(p) AS p FROM n{k} GROUP BY customer, z) x)",
            f"z{k} AS (SELECT z, p / sum(p) OVER () AS p FROM (SELECT z, sum(p) AS p FROM n{k} GROUP BY z) x)"]
    return ",\n".join(out)
