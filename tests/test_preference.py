"""Loss formulas against a plain-Python model on random rows."""

import math
import random

from stepwise.operators import preference as P


def ls(x):
    return -math.log1p(math.exp(-x)) if x >= 0 else x - math.log1p(math.exp(x))


def sig(x):
    return 1 / (1 + math.exp(-x))


def test_row_losses(spark):
    random.seed(7)
    rows = [(i, 0, *(random.uniform(-5, 0) for _ in range(4))) for i in range(50)]
    df = spark.createDataFrame(rows, "pair_id long, batch_id long, chosen_logps double, rejected_logps double, "
                                     "ref_chosen_logps double, ref_rejected_logps double")
    beta, eps = 0.1, 0.1
    model = {
        "sigmoid": lambda z, cl, rl: -ls(beta * z),
        "robust": lambda z, cl, rl: (-ls(beta * z) * (1 - eps) + ls(-beta * z) * eps) / (1 - 2 * eps),
        "hinge": lambda z, cl, rl: max(0.0, 1 - beta * z),
        "ipo": lambda z, cl, rl: (z - 1 / (2 * beta)) ** 2,
        "apo_zero": lambda z, cl, rl: 1 - sig(beta * cl) + sig(beta * rl),
        "cmcl": lambda z, cl, rl: -cl + rl + 0.05 * cl ** 2 + 0.05 * rl ** 2,
    }
    for lt, f in model.items():
        kw = {"label_smoothing": eps} if lt == "robust" else {}
        got = {r["pair_id"]: r["loss"] for r in P.preference_loss(df, lt, beta=beta, **kw).collect()}
        for pid, _, c, r, rc, rr in rows:
            want = f((c - r) - (rc - rr), c - rc, r - rr)
            assert math.isclose(got[pid], want, rel_tol=1e-9, abs_tol=1e-12), lt


def test_stable_log_sigmoid_extremes(spark):
    df = spark.createDataFrame([(0, 0, 900.0, -900.0, 0.0, 0.0)], "pair_id long, batch_id long, chosen_logps double, "
                               "rejected_logps double, ref_chosen_logps double, ref_rejected_logps double")
    r = P.preference_loss(df, "sigmoid", beta=1.0).collect()[0]
    assert r["loss"] == 0.0 or r["loss"] < 1e-300


def test_pairs_without_reference_or_nll_stay(spark):
    import math
    from stepwise.operators import preference as P
    pairs = spark.createDataFrame([(1, 0, -1.0, -2.0, -1.5, -1.8), (2, 1, -1.0, -2.0, -1.5, -1.8)],
                                  ["pair_id", "batch_id", P.C, P.R, P.RC, P.RR])
    nll = spark.createDataFrame([(0, 0.5)], "batch_id long, nll_loss double")
    for out in (P.preference_loss(pairs, "sft", batch_nll=nll), P.weighted_losses(pairs, ["sigmoid"], rpo_alpha=1.0, batch_nll=nll)):
        got = {r["pair_id"]: r["loss"] for r in out.collect()}
        assert len(got) == 2 and not math.isnan(got[1]) and math.isnan(got[2])
    some = P.attach_reference(pairs.drop(P.RC, P.RR), pairs.where("pair_id = 1"))
    assert some.count() == 2 and some.where(f"{P.RC} is null").count() == 1


def test_mixed_losses_and_aux_term(spark):
    random.seed(3)
    rows = [(i, i // 5, *(random.uniform(-5, 0) for _ in range(4)), i / 10) for i in range(20)]
    df = spark.createDataFrame(rows, "pair_id long, batch_id long, chosen_logps double, rejected_logps double, "
                                     "ref_chosen_logps double, ref_rejected_logps double, aux_loss double")

    def by_pair(frame):
        return {r["pair_id"]: r for r in frame.collect()}

    sigmoid, hinge, aot = (by_pair(P.preference_loss(df, lt, beta=0.1)) for lt in ("sigmoid", "hinge", "aot"))
    got = by_pair(P.weighted_losses(df, ["sigmoid", "aot", "hinge"], [1.0, 0.5, 2.0], aux_coef=0.3, beta=0.1))
    plain = by_pair(P.weighted_losses(df, ["sigmoid"], aux_coef=0.3, beta=0.1))
    assert len(got) == len(plain) == 20
    for i in range(20):
        want = sigmoid[i]["loss"] + 0.5 * aot[i]["loss"] + 2 * hinge[i]["loss"] + 0.3 * i / 10
        assert abs(got[i]["loss"] - want) < 1e-9
        assert abs(got[i]["chosen_reward"] - 3.5 * sigmoid[i]["chosen_reward"]) < 1e-9
        assert abs(plain[i]["loss"] - sigmoid[i]["loss"] - 0.3 * i / 10) < 1e-9


def test_pair_table_from_tokens(spark):
    """One aggregate gives what the sums per side and the windowed length weighting give."""
    from stepwise.operators import preference as P
    rows = [(p, s, k, -0.25 * ((p * 7 + k * 3 + s) % 11), -0.125, k >= 2, p % 2) for p in range(6) for s in (0, 1) for k in range(3 + (p * (s + 1)) % 5)]
    rows.append((9, 0, 0, -1.0, 0.0, False, 1))                               # a side without loss tokens, the other without any
    tok = spark.createDataFrame(rows, "pair_id long, side int, pos int, logp double, lse2 double, in_loss boolean, batch_id int")
    sums = {(r["pair_id"], r["side"]): r for r in P.sequence_logps(tok, normalize=True).collect()}
    weights = {r["pair_id"]: r["policy_weight"] for r in P.policy_weights(tok.where("pair_id < 9")).collect()}
    desens = {(r["pair_id"], r["side"]): r["logps"] for r in P.length_desensitised_logps(tok, 0.5).collect()}
    plain = {r["pair_id"]: r for r in P.pair_logps(tok, ["sigmoid"], ("batch_id",), weighting=True).collect()}
    means = {r["pair_id"]: r for r in P.pair_logps(tok, ["sigmoid", "ipo"]).collect()}
    ld = {r["pair_id"]: r for r in P.pair_logps(tok, ["ipo"], ld_alpha=0.5).collect()}
    for p in range(6):
        for s, name in ((0, "chosen"), (1, "rejected")):
            assert abs(plain[p][f"{name}_logps"] - sums[p, s]["logps_sum"]) < 1e-12
            assert abs(means[p][f"{name}_logps"] - sums[p, s]["logps"]) < 1e-12
            assert abs(ld[p][f"{name}_logps"] - desens[p, s]) < 1e-12
            assert plain[p][f"n_{name}"] == sums[p, s]["n_loss_tokens"]
        assert abs(plain[p]["policy_weight"] - weights[p]) < 1e-12
    assert plain[9]["chosen_logps"] == 0.0 and means[9]["chosen_logps"] is None
