import random

import numpy as np
import pytest

from kilnspark.llm import pii
from kilnspark.llm.pii_samples import training_documents


@pytest.fixture(scope="module")
def field():
    return pii.fit()


def mentions(field, text, **how):
    return {(m.kind, m.text) for m in pii.infer([text], field, **how)[0]}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Checked by Torvin B. Melkar; stand-in: Isolde Quarrant", {("person", "Torvin B. Melkar"), ("person", "Isolde Quarrant")}),
        ("Acked-by: Melkar, Torvin <melkar.t@fernhall.example>", {("person", "Melkar, Torvin"), ("email", "melkar.t@fernhall.example")}),
        ("phone 0049 40 31125871\nimelkar [at] mail [dot] fernhall [dot] example", {("phone", "0049 40 31125871"), ("email", "imelkar [at] mail [dot] fernhall [dot] example")}),
        ("Ring (812) 555-0177 when it stops.", {("phone", "(812) 555-0177")}),
        ("Payroll has Steuer-ID: 00 512 617 518 on file.", {("id_number", "00 512 617 518")}),
        ("Sa fiche porte le n° de sécurité sociale 1 27 14 99 512 379 15.", {("id_number", "1 27 14 99 512 379 15")}),
        ("Send both boards to Flat 3, 84 Ashgrove Road, Tellbury.", {("address", "Flat 3, 84 Ashgrove Road, Tellbury")}),
        ("Merci de livrer au 12 bis rue de la Vernaye, 75118 Montreval.", {("address", "12 bis rue de la Vernaye, 75118 Montreval")}),
        ("Bitte an Lindenweg 12, 20144 Neuhafen liefern.", {("address", "Lindenweg 12, 20144 Neuhafen")}),
        ("A Viterbi decoder feeds the Reed-Solomon code; the Nyquist rule holds.", set()),
        ("Start value 4788778612, took 3 855 219 ns. Server 10.11.12.13:8080. Part no. AB-12345-6789, batch 231449257.", set()),
        ("always @(posedge clk) q <= 1; @pytest.fixture() decorates it. It waits at noon. Then it goes on.", set()),
        ("Word at 0x5b785821, lane 4, drive 13 mA, row 6.", set()),
        ("", set()),
        (" \r\n \n", set()),
    ],
)
def test_cases(field, text, want):
    assert mentions(field, text) == want


def scores(field, docs, **how):
    tp = fp = fn = 0
    for (_, gold), found in zip(docs, pii.infer([t for t, _ in docs], field, **how), strict=True):
        got, want = {(m.start, m.kind) for m in found}, {(a, k) for a, _, k in gold}
        tp, fp, fn = tp + len(got & want), fp + len(got - want), fn + len(want - got)
    return tp / (tp + fp), tp / (tp + fn)


def test_held_out_and_without_skip_edges(field):
    """Ablation: without the ties between places of a word mentions are lost."""
    docs = training_documents(500, seed=99)
    precision, recall = scores(field, docs)
    plain_precision, plain_recall = scores(field, docs, skip=False)
    assert precision > 0.94 and recall > 0.94
    assert recall - plain_recall > 0.01 and precision >= plain_precision


def test_a_clear_mention_lifts_others_however_far(field):
    alone = "\n\nBrassova Fernholt\n\n"
    clear = "Acked-by: Brassova Fernholt <b.fernholt@x.example>. As Brassova Fernholt said, it locks.\n"
    plain = "The Brassova Fernholt theorem and the Brassova Fernholt method agree.\n" * 3
    filler = "nothing changes while req_q is low.\n" * 400

    def odds(before):
        """Log odds of a person at the last word that stands alone."""
        out = []
        for skip in (True, False):
            b = pii._Batch([before + filler + alone], pii._Tokens(field.w))
            out.append(float(pii._logit(field.infer(b, skip)[-1, pii.PERSON])))
        return out

    for before, sign in ((clear, 1), (plain, -1)):
        tied, single = odds(before)
        assert sign * (tied - single) > 0.5, (before, tied, single)
        assert sign * tied > 0
    assert pii.name_key("Péronnets") == pii.name_key("PERONNET") and pii.name_key("Brassova") == pii.name_key("Brossava") != pii.name_key("Fernholt")


def test_marginals_against_all_labellings(field):
    r = np.random.default_rng(3)
    score = r.normal(size=(5, pii.K)).astype(np.float32)
    offsets = np.array([0, 3, 5])
    pairs = np.zeros((pii.K, pii.K))
    got = field.marginals(score, pii._steps(offsets), pairs)
    want, want_pairs = np.zeros((5, pii.K)), np.zeros((pii.K, pii.K))
    for lo, hi in ((0, 3), (3, 5)):
        grid = np.stack(np.meshgrid(*[np.arange(pii.K)] * (hi - lo), indexing="ij"), -1).reshape(-1, hi - lo)
        w = np.exp(sum(score[lo + k][grid[:, k]] for k in range(hi - lo)) + sum(field.near[grid[:, k], grid[:, k + 1]] for k in range(hi - lo - 1)))
        w /= w.sum()
        for k in range(hi - lo):
            np.add.at(want[lo + k], grid[:, k], w)
            if k + 1 < hi - lo:
                np.add.at(want_pairs, (grid[:, k], grid[:, k + 1]), w)
    assert np.allclose(got, want, atol=1e-6) and np.allclose(pairs, want_pairs, atol=1e-5)


def test_batches_do_not_matter(field):
    texts = [t for t, _ in training_documents(60, seed=5)] + [None, ""]
    random.Random(1).shuffle(texts)
    key = lambda ms: [(m.start, m.end, m.kind) for m in ms]
    whole = [key(x) for x in pii.infer(texts, field)]
    assert whole == [key(pii.infer([t], field)[0]) for t in texts]


def test_long_text(field):
    text = "word " * 60_000 + "Acked-by: Torvin Melkar <melkar.t@fernhall.example>"
    assert {k for k, _ in mentions(field, text)} == {"person", "email"}


def test_frames(spark):
    df = spark.createDataFrame([(1, "😀 mail a.b@c.example now", "q"), (1, "😀 mail a.b@c.example now", "q"), (2, None, None), (3, "", None)], "doc_id long, text string, pii_type string")
    assert [tuple(r) for r in pii.find_mentions(df).collect()] == [(1, 7, "email")]
    got = {r["doc_id"]: (r["text"], r["n_mentions"]) for r in pii.mask_documents(df).collect()}
    assert got == {1: ("😀 mail [EMAIL] now", 1), 2: (None, 0), 3: ("", 0)}
    assert pii.find_mentions(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("to a.belkor at fernhall dot test; quist@fernhall.test", {"a.belkor at fernhall dot test", "quist@fernhall.test"}),
        ("Its number 512-77-0311. 83746582910384756 === is a hash", set()),
        ("L'étage de sortie dépend de L'horloge de base", set()),
    ],
)
def test_borders(field, text, want):
    assert {t for k, t in mentions(field, text) if k in ("email", "person")} == want


def test_flats_begin_an_address(field):
    assert mentions(field, "Best,\nTorvin Melkar\nFlat 9, 4 Ashgrove Road, Tellbury\n") == {("person", "Torvin Melkar"), ("address", "Flat 9, 4 Ashgrove Road, Tellbury")}
