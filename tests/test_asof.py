"""As-of helpers against brute force, with rows on and around bucket edges."""

import random

from intentlane.operators.asof import next_within, prev_within


def _data(seed, horizon):
    rnd = random.Random(seed)
    left, right = [], []
    for u in ("a", "b"):
        for i in range(150):
            left.append((len(left), u, rnd.randint(0, 40 * horizon)))
        for i in range(60):
            t = rnd.randint(0, 40 * horizon)
            right.append((u, t))
            if i % 10 == 0:                       # exact hits on edges and on left times
                right.append((u, (t // (4 * horizon)) * 4 * horizon))
                right.append((u, left[rnd.randrange(len(left))][2]))
    return left, right


def test_prev_and_next_within_match_brute_force(spark):
    h = 1000
    left, right = _data(11, h)
    ldf = spark.createDataFrame(left, "id long, user_id string, t long")
    rdf = spark.createDataFrame(right, "user_id string, t long")
    prev = {r.id: r.prev_t for r in prev_within(ldf, rdf, ["user_id"], "t", h).collect()}
    nxt = {r.id: r.next_t for r in next_within(ldf, rdf, ["user_id"], "t", h).collect()}
    for i, u, t in left:
        cands = [rt for ru, rt in right if ru == u and t - h < rt <= t]
        assert prev[i] == (max(cands) if cands else None)
        cands = [rt for ru, rt in right if ru == u and t < rt <= t + h]
        assert nxt[i] == (min(cands) if cands else None)
