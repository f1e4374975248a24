"""Brute-force definitions that the Spark plans are held to, and small frames."""

from collections import defaultdict

DDL = (
    "transaction_id string, entity_id string, counterparty_id string, txn_datetime string, txn_epoch long, amount_cents long, amount_cad double, direction string, channel string, is_cash int, "
    "is_suspicious int, typology string, typology_variant string, case_id string"
)
DAY, HOUR = 86_400, 3_600
T0 = 1_704_067_200  # a Monday, midnight UTC


def pay(n, entity, cp, epoch, cents, direction="inbound", cash=0, channel="eft", suspicious=0, typology="", variant="", case=""):
    return (f"TXN-{n:05d}", entity, cp, "", epoch, cents, cents / 100, direction, "cash" if cash else channel, cash, suspicious, typology, variant, case)


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL)


def by_entity(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[1]].append({"id": r[0], "e": r[1], "cp": r[2] or "", "t": r[4], "c": r[5], "d": r[7], "cash": r[9]})
    return {k: sorted(v, key=lambda x: (x["t"], x["id"])) for k, v in out.items()}


def plain_features(rows):
    """id -> features, from their definitions."""
    every = [x for v in by_entity(rows).values() for x in v]
    first, pair = {}, {}
    for x in every:
        if x["cp"]:
            first[x["cp"]] = min(first.get(x["cp"], x["t"]), x["t"])
            pair[x["cp"], x["e"]] = min(pair.get((x["cp"], x["e"]), x["t"]), x["t"])
    out = {}
    for own in by_entity(rows).values():
        for i, x in enumerate(own):
            back = lambda w, x=x, own=own: [y for y in own if x["t"] - w <= y["t"] <= x["t"]]
            w7, w30, w48, prior = back(7 * DAY), back(30 * DAY), back(48 * HOUR), own[:i]
            n = len(prior)
            mean = sum(y["c"] for y in prior) / n if n else None
            var = sum(y["c"] ** 2 for y in prior) / n - mean * mean if n else None
            sigma = var**0.5 if var is not None and var > 0 else 0
            into, gone = sum(y["c"] for y in w48 if y["d"] == "inbound"), sum(y["c"] for y in w48 if y["d"] == "outbound")
            out[x["id"]] = {
                "txn_count_7d": len(w7), "txn_sum_7d_cents": sum(y["c"] for y in w7), "txn_count_30d": len(w30), "txn_sum_30d_cents": sum(y["c"] for y in w30),
                "amount_zscore_entity": (x["c"] - mean) / sigma if n >= 5 and sigma >= 1e-9 else 0.0, "is_round_amount": int(x["c"] % 100_000 == 0),
                "days_since_prev_txn": (x["t"] - own[i - 1]["t"]) / 86400 if i else -1.0, "distinct_counterparties_7d": len({y["cp"] for y in w7 if y["cp"]}),
                "outbound_to_inbound_ratio_48h": min(gone / into, 10.0) if into else 0.0, "cash_ratio_7d": sum(y["c"] for y in w7 if y["cash"]) / sum(y["c"] for y in w7),
                "counterparty_entity_degree_asof": sum(1 for (c, _), t in pair.items() if c == x["cp"] and t <= x["t"]) if x["cp"] else 0,
                "counterparty_age_days": (x["t"] - first[x["cp"]]) / 86400 if x["cp"] else 0.0,
                "new_counterparty_ratio_7d": sum(1 for y in w7 if y["cp"] and first[y["cp"]] >= x["t"] - 7 * DAY) / len(w7),
                "prior_txn_count": n, "prior_mean_cents": mean or 0.0,
            }
    return out


def plain_structuring(rows, floor=750_000, ceiling=999_999, least=3, window=7 * DAY):
    """id -> (deposits, total) of the largest window anchored at a deposit, the earliest of equals."""
    best = {}
    for own in by_entity(rows).values():
        d = [x for x in own if x["cash"] and x["d"] == "inbound" and floor <= x["c"] <= ceiling]
        for i, a in enumerate(d):
            part = [x for x in d[i:] if x["t"] <= a["t"] + window]
            if len(part) >= least:
                for x in part:
                    if len(part) > best.get(x["id"], (0,))[0]:
                        best[x["id"]] = (len(part), sum(y["c"] for y in part))
    return best


def plain_layering(rows, inbound=1_500_000, legs=3, cps=3, through=0.7, window=48 * HOUR):
    """id -> (anchor, legs, counterparties) of the last anchor."""
    out = {}
    for own in by_entity(rows).values():
        for i, a in enumerate(own):
            if a["d"] != "inbound" or a["c"] < inbound:
                continue
            part = [x for x in own[i + 1 :] if x["d"] == "outbound" and x["t"] <= a["t"] + window]
            names = {x["cp"] for x in part if x["cp"]}
            if len(part) >= legs and len(names) >= cps and sum(x["c"] for x in part) / a["c"] >= through:
                for x in [a, *part]:
                    out[x["id"]] = (a["id"], len(part), len(names))
    return out


def plain_smurfing(rows, senders=8, cv=0.35, mean=500_000, window=72 * HOUR):
    """id -> (anchor, senders, payments) of the last anchor."""
    out = {}
    for own in by_entity(rows).values():
        d = [x for x in own if x["d"] == "inbound" and x["cp"]]
        for i, a in enumerate(d):
            part = [x for x in d[i:] if x["t"] <= a["t"] + window]
            m = sum(x["c"] for x in part) / len(part)
            spread = (sum((x["c"] - m) ** 2 for x in part) / len(part)) ** 0.5 / m
            names = {x["cp"] for x in part}
            if len(names) >= senders and m <= mean and spread < cv:
                for x in part:
                    out[x["id"]] = (a["id"], len(names), len(part))
    return out


def plain_large_cash(rows, total=1_000_000, window=DAY):
    out = set()
    for own in by_entity(rows).values():
        d = [x for x in own if x["cash"] and x["d"] == "inbound"]
        for end in d:
            part = [x for x in d if end["t"] - window <= x["t"] <= end["t"]]
            if sum(x["c"] for x in part) >= total:
                out |= {x["id"] for x in part}
    return out
