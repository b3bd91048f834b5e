import random

from reqlens.llm.preference import preference_pairs

SCHEMA = "pair_id long, turn int, role string, text string"


def rendered(turns):
    text, mask = "", []
    for role, body in turns:
        start = len(text) + len(role) + 5
        if role == "assistant":
            mask.append((start, start + len(body)))
        text += f"<|{role}|>\n{body}\n"
    return text, mask


def brute(chosen, rejected):
    def numbered(rows):
        out = {}
        for pair, turn, role, text in rows:
            if pair is not None:
                out.setdefault(pair, {}).setdefault(-1 if turn is None else turn, []).append((role or "", text or ""))
        return {p: {t: sorted(v) for t, v in turns.items()} for p, turns in out.items()}

    c, r, out = numbered(chosen), numbered(rejected), {}
    for pair in c.keys() | r.keys():
        a, b = c.get(pair, {}), r.get(pair, {})
        fork = min((t for t in a.keys() | b.keys() if a.get(t) != b.get(t)), default=None)
        flat = lambda turns, test: [x for t in sorted(turns) if test(t) for x in turns[t]]
        prompt = flat(a, lambda t: fork is None or t < fork)
        after = lambda t: fork is not None and t >= fork
        out[pair] = (len(prompt), rendered(prompt)[0], *rendered(flat(a, after)), *rendered(flat(b, after)))
    return out


def result(spark, chosen, rejected):
    got = preference_pairs(spark.createDataFrame(chosen, SCHEMA), spark.createDataFrame(rejected, SCHEMA)).collect()
    spans = lambda mask: [(s.start, s.end) for s in mask]
    return {x.pair_id: (x.prompt_turns, x.prompt, x.chosen, spans(x.chosen_mask), x.rejected, spans(x.rejected_mask)) for x in got}


def test_pairs_equal_brute_force(spark):
    r = random.Random(3)
    chosen, rejected = [], []
    for pair in range(40):
        turns = [(pair, t, "user" if t % 2 == 0 else "assistant", f"text {r.randrange(3)} of turn {t}") for t in range(r.randint(1, 6))]
        fork = r.randint(0, len(turns))
        chosen += turns
        rejected += turns[:fork] + [(pair, t, role, "other " + text) for _, t, role, text in turns[fork:]]
    r.shuffle(chosen)
    assert result(spark, chosen, rejected) == brute(chosen, rejected)


def test_edges(spark):
    chosen = [(1, 0, None, None), (1, None, "user", "x"), (2, 0, "user", "a"), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"),
              (None, 0, "user", "lost"), (3, 0, "user", "only here"), (5, 0, "assistant", "y" * 100_000)]
    rejected = [(1, 0, "", ""), (1, None, "user", "x"), (2, 0, "assistant", "b"), (2, 0, "user", "a"), (2, 0, "assistant", "b"), (4, 7, "user", ""), (5, 0, "assistant", "")]
    want = brute(chosen, rejected)
    assert result(spark, chosen, rejected) == want
    assert want[2][0] == 3 and want[3][0] == 0 and None not in want
    assert result(spark, [], []) == {}
