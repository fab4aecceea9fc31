import random

import pytest

from kilnspark.llm.pairs import TILE, defect_of, defect_rates, greedy_tiles, is_refusal, pair_defects, untiled

Q = "Write a counter in Verilog please, it must wrap.\n\n## Specification\nThe counter is cleared by the reset and wraps at nine. It has an enable."
CODE = "```verilog\nmodule m(input c);\n  always @(posedge c) begin x <= 1; end\nendmodule\n```"


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        (None, "empty"),
        (" ​...", "empty"),
        ("```verilog\n\n```", "empty"),
        (CODE, None),
        ("Here is the module. It counts.\n\n" + CODE, None),
        (CODE[:-16], "truncated"),
        (CODE[:40], "truncated"),
        (CODE.replace("endmodule\n", ""), "truncated"),
        (CODE + "\n\nThe counter must hold its", "truncated"),
        ("I'm sorry, but I can't write this design.", "refusal"),
        ("Lo siento, no puedo ayudar con esta petición.", "refusal"),
        ("```verilog\n// I am unable to produce the requested module.\n```", "refusal"),
        ("The output can't change while the block is unable to accept data.\n\n" + CODE, None),
        ("Sorry about the earlier slip: the counter cannot wrap any more.\n\n" + CODE, None),
        ("Sure! " + Q, "copy"),
        (Q.upper(), "copy"),
        ("The counter is cleared by the reset and wraps at nine. It has an enable.", "copy"),
        ("Der Zähler wird nach dem Rücksetzen nicht mehr verändert und ist leer.\n\n" + CODE, "other_language"),
        ("Счётчик удерживает значение, пока сигнал активен.\n\n" + CODE, "other_language"),
    ],
)
def test_defects(answer, want):
    assert defect_of(Q, answer) == want


@pytest.mark.parametrize("answer", [" " * 401, "\u200b" * 401, "." * 500, "```verilog\n```\n" * 50, " \n" * 5000 + "?!"])
def test_long_empty(answer):
    assert defect_of(Q, answer) == "empty"


REASONS = "The request names a protected interface whose terms forbid a copy. The vendor publishes a data sheet that lists every port. " * 8


@pytest.mark.parametrize(
    "answer",
    [
        "I'm sorry, but I can't write this design.\n\n" + REASONS,
        REASONS + "\n\nFor these reasons I must decline.",
        REASONS + "\n\nTherefore I will not provide the module.\n\n" + REASONS,
        "Lo siento, no puedo ayudar con esta petición. " + "El fabricante publica una hoja de datos con todos los puertos. " * 12,
    ],
)
def test_long_refusal(answer):
    assert len(answer) > 600 and defect_of(Q, answer) == "refusal"


@pytest.mark.parametrize("answer", [REASONS, REASONS + "\n\n" + CODE, "The output can't change while the block is unable to accept data. " * 12])
def test_long_answer_is_no_refusal(answer):
    assert defect_of(Q, answer) is None


BROKEN = CODE.replace(" end\nendmodule", "")


@pytest.mark.parametrize(
    "answer",
    [
        "The counter does this:\n1. It is cleared.\n2. It wraps.\n3.",
        "The note says “the counter wraps at nine. It is cleared.",
        'The note says "the counter wraps at nine. It is cleared.',
        "The counter wraps (see the note\non the reset. It is cleared.",
        "The counter **wraps at\nnine. It is cleared.",
        "The counter <b>wraps at nine. It is cleared.",
        BROKEN + "\n\nThat was the first part, and this is the second.\n\n" + CODE,
        BROKEN + "\n\nThat was the first part, and this is the second.\n\n" + CODE + "\n\nBoth are whole.",
    ],
)
def test_left_open_early(answer):
    assert defect_of(Q, answer) == "truncated"


@pytest.mark.parametrize(
    "answer",
    [
        "The counter (see [1, 8) and\nthe note) wraps. It's cleared :)\n\na) It wraps.\nb) It holds 2**3 beats.",
        'The note says "the counter wraps", “it is cleared” and „it holds“. Its bus is 5" long.',
        "The counter **wraps** and `count[3:` is cut in <b>bold</b>. It is cleared.",
        CODE + "\n\nThis is the second part.\n\n" + CODE,
    ],
)
def test_closed(answer):
    assert defect_of(Q, answer) is None


def test_copy_of_two_parts():
    q = "Extend the module please, it must wrap at nine.\n\n## Specification\nThe counter is cleared by the reset and wraps at nine.\n\n## Code so far\n" + CODE
    assert defect_of(q, "Sure!\n\n" + CODE + "\n\nThe counter is cleared by the reset and wraps at nine.") == "copy"
    assert defect_of(q, "Sure!\n\n" + CODE + "\n\nThe counter is cleared by the reset and wraps at ten, as the new text says.") is None


def test_copy_with_other_spacing():
    q = "Repair this module.\n\n## Specification\nIt counts to nine.\n\n## Code so far\n" + CODE
    assert defect_of(q, " ".join(q.split())) == "copy"
    assert defect_of(q, "Sure! " + " ".join(CODE.split())) == "copy"


@pytest.mark.parametrize(
    ("question", "answer", "want"),
    [
        ("Explica qué hace este módulo.", "The counter holds its value while the enable is low.", "other_language"),
        ("Explica qué hace este módulo.", "El contador conserva su valor mientras la señal está en cero.", None),
        ("Was macht dieses Modul?", "Счётчик удерживает значение, пока сигнал активен.", "other_language"),
        ("Erkläre, was dieses Modul macht.", "Der Zähler behält seinen Wert, während das Signal nicht aktiv ist.", None),
        ("Adder tree, 8 bit, signed", "当信号为高电平时,计数器清零。", "other_language"),
        ("加法器", "当信号为高电平时,计数器清零。", None),
    ],
)
def test_language_of_short_questions(question, answer, want):
    assert defect_of(question, answer) == want


def test_null_question():
    assert defect_of(None, CODE) is None and defect_of(None, "") == "empty"


def test_frame(spark):
    s = "sample_id long, messages array<struct<role:string,content:string>>, defect string"
    rows = [(1, [("user", Q), ("assistant", CODE), ("user", "more?"), ("user", Q), ("assistant", "")], "x"), (2, None, None), (3, [("user", None)], None), (1, [("user", Q), ("assistant", CODE), ("user", "more?"), ("user", Q), ("assistant", "")], "x")]
    got = {tuple(r) for r in pair_defects(spark.createDataFrame(rows, s)).collect()}
    assert got == {(1, 2, "empty"), (1, 3, "empty"), (3, 1, "empty")}


@pytest.mark.parametrize(
    "answer",
    [
        "I don't see a problem here, because the counter wraps at 15.",
        "We won't need a reset, since the tool sets the register.",
        "I cannot use a latch here, so the register holds it.",
        "It is not possible for the queue to overflow.",
        "I would not change the width.",
        "We must not write the register twice.",
    ],
)
def test_no_deed_of_the_task_is_declined(answer):
    assert not is_refusal(answer)


@pytest.mark.parametrize(
    "answer",
    [
        "I can't assist with this request.", "I must respectfully decline.", "Sorry, I will not be able to complete this task for you.", "I'm not comfortable writing this.", "This request is outside what I can do.", "I'm afraid I can't do that.",
        "I can not, in good conscience, produce that design.", "Ich kann dir dabei nicht helfen.", "Leider kann ich diesen Code nicht schreiben.", "Je ne peux pas vous aider avec cette demande.", "No puedo escribir ese módulo.", "My answer to this is no.",
    ],
)
def test_task_is_declined(answer):
    assert is_refusal(answer)


def brute_tiles(a, b, least):
    """Greedy string tiling as defined: in each round all longest unmarked runs are marked."""
    ua, ub, out = set(), set(), []
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in ua and j + n not in ub:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best and n >= least:
                    found.append((i, j))
        if best < least:
            return out
        for i, j in found:
            if not (ua & set(range(i, i + best)) or ub & set(range(j, j + best))):
                ua |= set(range(i, i + best))
                ub |= set(range(j, j + best))
                out.append((i, j, best))


def test_tiles_against_definition():
    r = random.Random(6)
    for _ in range(150):
        b = [f"t{k}" for k in range(30)]  # no token twice, so that the tiling is the only one
        a = []
        while len(a) < 30:
            i = r.randrange(30)
            a += b[i : i + r.randint(1, 8)] + [f"x{len(a)}"]
        got = greedy_tiles(a, b)
        assert sum(n for *_, n in got) == sum(n for *_, n in brute_tiles(a, b, TILE))
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in got)
        assert len({x for i, _, n in got for x in range(i, i + n)}) == len({x for _, j, n in got for x in range(j, j + n)}) == sum(n for *_, n in got)


def test_tiling_of_repetitive_texts_is_fast():
    assert defect_of("x " * 60_000, "x " * 60_000) == "copy"
    assert untiled(["a", "b", "c"] * 3, ["a", "b", "c"]) == 0


def test_rates(spark):
    s = "sample_id long, messages array<struct<role:string,content:string>>, task_type string, n_pairs int"
    rows = [(1, [("user", Q), ("assistant", CODE), ("user", Q), ("assistant", "")], "a", 1), (1, [("user", Q), ("assistant", CODE), ("user", Q), ("assistant", "")], "a", 1), (2, None, None, 1), (3, [("user", None)], None, 1)]
    assert {tuple(x) for x in defect_rates(spark.createDataFrame(rows, s)).collect()} == {("a", "empty", 2, 1), (None, "empty", 1, 1)}
