"""Folds and matches that SQL can't say, against plain Python on whole small tables."""

from collections import defaultdict

from pyspark.sql import functions as F

from tessera.operators import folds
from tessera.operators.chains import lifecycle
from tessera.plans import catalogue
from tessera.plans.folds import releases
from tessera.plans.ordered import DAY
from tessera.sources.tables import micros, table

SF = "/root/testdata/sf0.001"


def by_key(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[k] for k in key)].append(r)
    return out


def test_deals(spark):
    rank = {"announcement": 0, "upsize": 1, "close": 2}
    want = {}
    for rows in by_key(releases(spark, SF).collect(), ["ticker"]).values():
        deals, n = [], 0
        for r in sorted(rows, key=lambda r: (r.day, rank[r.role], r.o_orderkey)):
            deals = [d for d in deals if not d["closed"] and r.day - d["last"] <= 120]

            def score(d, r=r):
                return 3 * (d["price"] == r.price) + 2 * (d["kind"] == r.kind) + (abs(d["amount"] - r.amount) <= 0.2 * max(d["amount"], r.amount))

            best = sorted(deals, key=lambda d: (score(d), d["n"]))[-1:]
            points, second = (score(best[0]) if best else 0), None
            if r.role == "close" and points < 5:
                pairs = [(a, b) for a in deals for b in deals if a["n"] < b["n"] and abs(a["amount"] + b["amount"] - r.amount) <= 0.02 * r.amount]
                if pairs:
                    first, second = sorted(pairs, key=lambda p: (p[0]["n"], p[1]["n"]))[-1]
                    best, points = [first], 9
            if points < (5 if r.role == "announcement" else 2):
                n += 1
                best = [{"n": n, "kind": r.kind, "amount": r.amount, "price": r.price, "closed": False}]
                deals.append(best[0])
            for d in best + ([second] if second else []):
                d["last"] = r.day
                if r.role == "upsize":
                    d["amount"] = r.amount
                d["closed"] = d["closed"] or r.role == "close"
            want[r.o_orderkey] = (best[0]["n"], second["n"] if second else None)
    got = {r.o_orderkey: (r.deal, r.deal_two) for r in catalogue.QUERIES["wn_deals"](spark, SF).collect()}
    assert got == want and len({d for d, _ in got.values()}) > 1


def test_a_close_of_two_deals_belongs_to_both(spark):
    rows = [(1, 1, 10, "announcement", "units", 1000, 1), (1, 2, 12, "announcement", "notes", 3000, 2), (1, 3, 20, "close", "other", 4010, 9), (1, 4, 30, "close", "units", 1000, 1), (2, 5, 20, "close", "units", 5, 5)]
    frame = spark.createDataFrame(rows, "ticker int, id long, day int, role string, kind string, amount long, price long")
    got = {r.id: (r.deal, r.deal_two) for r in folds.deals(frame, ["ticker"], "day", "id").collect()}
    assert got == {1: (1, None), 2: (2, None), 3: (1, 2), 4: (3, None), 5: (1, None)}
    assert folds.deals(frame.limit(0), ["ticker"], "day", "id").collect() == []


def test_greedy_pairs(spark):
    orders = table(spark, SF, "orders").collect()
    want = set()
    for key, rows in by_key(orders, ["o_custkey"]).items():
        cents = lambda r: int(F_round(r.o_totalprice * 100))
        free = sorted((r for r in rows if r.o_orderkey % 2 == 1), key=lambda r: r.o_orderkey)
        for lab in sorted((r for r in rows if r.o_orderkey % 2 == 0), key=lambda r: r.o_orderkey):
            points = [(2 * (p.o_orderpriority == lab.o_orderpriority) + 2 * (abs(cents(p) - cents(lab)) <= 0.1 * max(cents(p), cents(lab)))) for p in free]
            if points and max(points):
                at = points.index(max(points))
                want.add((key[0], lab.o_orderkey, free.pop(at).o_orderkey, max(points)))
            else:
                want.add((key[0], lab.o_orderkey, None, 0))
        want |= {(key[0], None, p.o_orderkey, 0) for p in free}
    got = {tuple(r) for r in catalogue.QUERIES["jn_greedy_pairs"](spark, SF).collect()}
    assert got == want


def F_round(x):
    from decimal import ROUND_HALF_UP, Decimal

    return Decimal(repr(x)).quantize(Decimal(1), ROUND_HALF_UP)


def test_lifecycles(spark):
    want = {}
    rows = table(spark, SF, "orders").select("*", micros(F.col("o_orderdate")).alias("at")).collect()
    for rs in by_key(rows, ["o_custkey", "o_orderpriority"]).values():
        chains, n = [], 0
        for r in sorted(rs, key=lambda r: (r["at"], r.o_orderkey)):
            chains = [c for c in chains if r["at"] - c["last"] <= 400 * DAY]
            fits = [c for c in chains if c["closed"] is None or (c["stage"] == r.o_orderstatus and r["at"] - c["closed"] <= 30 * DAY)]
            if not fits:
                n += 1
                fits = [{"n": n, "closed": None}]
                chains.append(fits[0])
            fits[-1].update(last=r["at"], stage=r.o_orderstatus, closed=r["at"] if r.o_orderstatus == "P" else None)
            want[r.o_orderkey] = fits[-1]["n"]
    found = catalogue.QUERIES["ch_lifecycle"](spark, SF).collect()
    assert {r.o_orderkey: r.chain for r in found} == want
    sizes = defaultdict(int)
    for r in found:
        sizes[r.o_custkey, r.o_orderpriority, r.chain] += 1
    assert all(r.chain_items == sizes[r.o_custkey, r.o_orderpriority, r.chain] for r in found)
    empty = table(spark, SF, "orders").limit(0).select("o_custkey", "o_orderkey", micros(F.col("o_orderdate")).alias("at"), "o_orderstatus", "o_totalprice")
    assert lifecycle(empty, ["o_custkey"], "at", "o_orderkey", "o_orderstatus", "o_totalprice", ["P"], 1, 1).collect() == []


def test_filled_chains_by_brute_force(spark):
    import random

    random.seed(11)
    rows = [(random.choice([None, 1, 2, 3, 4]), n, random.choice([None, "x", "y"]), random.choice([None, None, 1.0, 2.0]), random.choice("abc")) for n in range(120)] + [(9, 500, None, None, "a")]
    df = spark.createDataFrame(rows, "k int, n int, s string, v double, kind string").withColumn("more", F.lit(1))
    got = folds.filled_chain(df, ["k"], F.col("n"), "n", ["s", "v"], {"v": F.col("kind") == "b"}, (F.col("kind") == "c") & (F.col("n") % 4 == 0), {"s": F.col("kind") == "a"})
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: -r[1])
        new, told, values = mine[0], [], {"s": mine[0][2], "v": mine[0][3]}
        for name, at in (("s", 2), ("v", 3)):
            if values[name] is None and not (name == "s" and new[4] == "a"):
                for r in mine:
                    if r[at] is not None and not (name == "v" and r[4] == "b"):
                        values[name] = r[at]
                        told.append((name, r[1]))
                        break
                    if r[4] == "c" and r[1] % 4 == 0:
                        break
        want[k] = (new[1], values["s"], values["v"], len(mine), told)
    assert {r.k: (r.n, r.s, r.v, r.rows, [(p.field, p.source) for p in r.provenance]) for r in got.collect()} == want
    assert folds.filled_chain(df.limit(0), ["k"], F.col("n"), "n", ["s"]).collect() == []
    plain = folds.filled_chain(df.where("k = 9"), ["k"], F.col("n"), "n", ["s", "v"]).head()
    assert (plain.n, plain.s, plain.v, plain.rows, plain.provenance) == (500, None, None, 1, [])
