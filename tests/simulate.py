"""Small reference simulations of the reference's imperative loops, used as
brute-force oracles on fixtures."""

from __future__ import annotations


def sorted_set_detector(events, window_us, threshold, cooldown_us):
    """events: iterable of (user, t, tie) in arrival order per user (sorted
    here by (t, tie)). Returns (counts by tie, fired ties) the way the
    sorted-set counter with a set-if-absent lock would."""
    by_user = {}
    for u, t, tie in events:
        by_user.setdefault(u, []).append((t, tie))
    counts, fired = {}, set()
    for u, rows in by_user.items():
        rows.sort()
        window = []
        lock_until = None
        for t, tie in rows:
            window = [x for x in window if x > t - window_us]
            window.append(t)
            n = len(window)
            counts[tie] = n
            if n >= threshold and (lock_until is None or t >= lock_until):
                fired.add(tie)
                lock_until = t + cooldown_us
    return counts, fired


def compound_cap_sim(events, gap_us, window_us, max_in_window):
    by_user = {}
    for u, t, tie in events:
        by_user.setdefault(u, []).append((t, tie))
    allowed = set()
    for u, rows in by_user.items():
        rows.sort()
        sends = []
        for t, tie in rows:
            recent = [s for s in sends if s > t - window_us]
            if (not sends or sends[-1] <= t - gap_us) and len(recent) <= max_in_window:
                sends.append(t)
                allowed.add(tie)
    return allowed
