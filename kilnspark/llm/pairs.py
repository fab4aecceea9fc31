"""Question-answer pairs whose answer is broken, each with its defect.

A pushdown parser walks the answer: fences, comments, strings, brackets and the
block words of the hardware language are pushed and popped, conditional
branches start from the same stack, and what is still open at the end of a
block tells that the code breaks off; prose must end its last sentence or list
item and close its brackets, quotations, bold and tags.  Copies are found by
greedy string tiling of the answer with the question, refusals by a grammar of
subject, declining predicate, deed and task in several languages, the language
of the prose by script and by function words.

A pair has one defect, tested in the order empty, refusal, copy,
other_language, truncated.

Defined results: null messages make no pair; a user message without an
assistant message right after it is 'empty', and so is a null answer; a null
question has no language and nothing to copy; redelivered rows count once.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ------------------------------------------------------------------ prose and code

_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[ \t]*([\w+#.-]*)[^\n]*$")
_CODE_LINE = re.compile(r"\s*(//|/\*|\(\*|`(?:timescale|ifdef|ifndef|include|define|default_nettype)\b|module\s+\w|package\s+\w|interface\s+\w+\s*[(;#]|import\s+\w+::)")
_CODE_WORD = re.compile(r"^\s*(?:module\b|endmodule\b|assign\s|always|input\s|output\s|wire\s|reg\s|logic\s|parameter\s|localparam\s)", re.M)


def split_text(text: str) -> tuple[str, list[tuple[str, bool]], bool]:
    """(prose, [(code, closed)], whether the text ends in code).  Code outside fences starts at its first typical line and is open until ``endmodule``."""
    prose, blocks, cur, mark, ends = [], [], None, "", False
    for line in text.split("\n"):
        m = _FENCE.match(line.rstrip("\r"))
        if cur is None:
            if m:
                cur, mark, ends = [], m[1][:3], True
            else:
                prose.append(line)
                if line.strip():
                    ends = False
        elif m and m[1][:3] == mark and not m[2]:
            blocks.append(("\n".join(cur), True))
            cur = None
        else:
            cur.append(line)
    if cur is not None:
        blocks.append(("\n".join(cur), False))
    if blocks:
        return "\n".join(prose), blocks, ends
    lines = text.split("\n")
    first = next((k for k, x in enumerate(lines) if _CODE_LINE.match(x)), None)
    if first is None:
        return text, [], False
    last = next((k for k in range(len(lines) - 1, first, -1) if re.match(r"\s*end(module|package|interface|class)\b", lines[k])), None)
    if last is None:
        return "\n".join(lines[:first]), [("\n".join(lines[first:]), False)], True
    after = lines[last + 1 :]
    while after and (not after[0].strip() or _CODE_LINE.match(after[0])):
        last += 1
        after = after[1:]
    return "\n".join(lines[:first] + after), [("\n".join(lines[first : last + 1]), True)], not any(x.strip() for x in after)


_EVENT = re.compile(
    r'//[^\n]*|/\*[\s\S]*?\*/|/\*|"(?:[^"\\\n]|\\[\s\S])*"|"|`(?:ifdef|ifndef|elsif|else|endif)\b'
    r"|\b(?:begin|end|module|endmodule|case[xz]?|endcase|function|endfunction|task|endtask|generate|endgenerate|package|endpackage|interface|endinterface|class|endclass|fork|join(?:_any|_none)?)\b|[()\[\]{}]"
)
_OPENS = {
    "begin": "end", "module": "endmodule", "case": "endcase", "casex": "endcase", "casez": "endcase", "function": "endfunction", "task": "endtask",
    "generate": "endgenerate", "package": "endpackage", "interface": "endinterface", "class": "endclass", "fork": "join", "(": ")", "[": "]", "{": "}",
}
_CLOSES = frozenset(_OPENS.values()) | {"join_any", "join_none"}


def left_open(code: str) -> bool:
    """Whether something is still open at the end of the code."""
    stack: list[str] = []
    saved: list[list[str]] = []
    whole = False
    for t in _EVENT.findall(code):
        c = t[0]
        if c == "/":
            if t == "/*":
                return True
        elif c == '"':
            if len(t) == 1:
                return True
        elif c == "`":
            if t in ("`ifdef", "`ifndef"):
                saved.append(list(stack))
            elif t == "`endif":
                if saved:
                    saved.pop()
            elif saved:
                stack = list(saved[-1])
        elif t in _OPENS:
            stack.append("join" if t == "fork" else _OPENS[t])
        elif t in _CLOSES:
            want = "join" if t[:4] == "join" else t
            if stack and stack[-1] == want:
                stack.pop()
            elif want in stack:
                while stack.pop() != want:
                    pass
            whole = whole or t in ("endmodule", "endpackage", "endinterface", "endclass")
    return bool(stack or saved) or not (whole or _complete_fragment(code))


def _complete_fragment(code: str) -> bool:
    """A snippet without a module is complete if it ends a statement or block."""
    bare = re.sub(r"//[^\n]*|/\*[\s\S]*?\*/", "", code).rstrip()
    return bare.endswith((";", "end", "}", ")")) and not re.match(r"\s*(`|module\b)", bare)


_SENTENCE_END = re.compile(r"[.!?…。！？।؟։፡](?:[\"'»”’)\]*_`」』\s]|</\w+>)*$|[.!?][\"'»”’)\]]+$")


_LIST_MARK = re.compile(r"[ \t]*(?:[-*+•]|\d{1,3}[.)]|\(?[a-zA-Z][.)])[ \t]*$")
_MARKUP = re.compile(
    r"(`+)(?!`)[^\n]*?(?<!`)\1(?!`)|(?<!\w)[:;]-?[()\[\]](?=\s|$)|</?(?:b|i|em|strong|code|a|pre|kbd|sub|sup|s|u|ul|ol|table|details|summary|div|span|blockquote)\b[^<>\n]*>"
    r'|\*\*|^[ \t]*(?:\d{1,3}|[a-zA-Z])\)|["“”„«»‘’「」『』()\[\]{}]',
    re.M,
)
_QUOTES = {"“": "”", "„": "“", "«": "»", "‘": "’", "「": "」", "『": "』"}
_ENDS = frozenset(_QUOTES.values())


def prose_left_open(prose: str) -> bool:
    """Whether a bracket, quotation, bold or tag of the prose is still open at its end: one stack over all of it.  Code spans are skipped, any bracket closes any other."""
    stack: list[str] = []

    def close(want: str) -> bool:
        if want not in stack:
            return False
        while stack.pop() != want:
            pass
        return True

    for m in _MARKUP.finditer(prose):
        t = m[0]
        before, after = prose[m.start() - 1 : m.start()], prose[m.end() : m.end() + 1]
        if t == "**":
            if not (before.strip() and close(t)) and after.strip() and not before.isalnum():
                stack.append(t)
        elif t == '"':
            if not close(t) and after.strip() and (not before.strip() or before in "([{“„«‘*_/=:,—–-"):
                stack.append(t)
        elif t in ("(", "[", "{"):
            stack.append("bracket")
        elif t in (")", "]", "}"):
            close("bracket")
        elif t[0] == "<":
            tag = re.match(r"</?(\w+)", t)[1]
            if t[1] == "/":
                close(tag)
            elif not t.endswith("/>"):
                stack.append(tag)
        elif t in _QUOTES or t in _ENDS:
            if t in _ENDS and close(t):
                continue
            if t == "»":  # »quoted« as well as «quoted»
                stack.append("«")
            elif t == "«" and close("«"):
                continue
            elif t in _QUOTES and not (_QUOTES[t] in stack and before in ("", "\n")):  # a further paragraph of a quotation opens it again
                stack.append(_QUOTES[t])
    return bool(stack)


def prose_breaks_off(prose: str) -> bool:
    """Whether the last sentence or list item of the prose, a bracket, quotation or markup in it is left open."""
    p = prose.rstrip(" \t\r\n​﻿")
    if not p:
        return False
    last = p.rsplit("\n", 1)[-1]
    if re.match(r"\s*(?:#+ |\|.*\|$)", last):  # a heading or a table row is no sentence
        return last.lstrip().startswith("#") or prose_left_open(p)
    return not _SENTENCE_END.search(p) or _LIST_MARK.match(last) is not None or prose_left_open(p)


def truncated(text: str, parts: tuple[str, list[tuple[str, bool]], bool]) -> bool:
    prose, blocks, ends_in_code = parts
    if not ends_in_code:
        return any(_CODE_WORD.search(code) and left_open(code) for code, _ in blocks) or prose_breaks_off(prose)
    code, closed = blocks[-1]
    return not closed or left_open(code) or any(_CODE_WORD.search(c) and left_open(c) for c, _ in blocks[:-1]) or prose_left_open(prose)


# ------------------------------------------------------------------ empty

_FENCE_ONLY = re.compile(r"^[ \t]*(?:```+|~~~+)[^\n`]*$", re.M)


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    lines = text.split("\n")
    return not any(unicodedata.category(c)[0] in "LN" for x in lines if not _FENCE_ONLY.fullmatch(x) for c in x)


# ------------------------------------------------------------------ refusal

# A refusal is a sentence in which the writer (or the answer itself) declines a deed that is the task: a grammar of
# subject, negated or declining predicate, verb of doing and, where the verb alone does not name the task, its object.


def _any(words: str) -> str:
    """One of several phrases, separated by bars; blanks stand for white space."""
    return "(?:" + "|".join(w.strip() for w in words.split("|")) + ")"


_EN_ADV = "(?: " + _any("really|simply|just|also|sadly|unfortunately|regrettably|therefore|currently|certainly|respectfully|politely|honestly|hereby|still|now|actually|even|possibly|in good conscience|at this time") + ",?)*"
_EN_TASK = _any("request|requests|task|question|prompt|module|modules|design|block|code|rtl|hdl|verilog|systemverilog|vhdl|circuit|implementation|answer|response|solution|file|exercise|problem|job|program|script|netlist|work")
# what the deed is done to: a pointer to the task, or up to four words and a noun of it
_EN_OBJECT = "(?:" + _any("this|that|it|you|so|such a thing|anything like that|either|what you ask(?:ed)?(?: for)?|what is asked|what was asked") + r"(?= ?[.,;:!?)—–-]| (?:for|as|because|since|without|here|to you|at|in this|with|due|under|unless|until|and)\b|$)|(?:\w[\w'-]* ){0,4}" + _EN_TASK + r"\b)"
_EN_FREE = _any("help|assist|comply|oblige|respond|proceed|continue|engage|go on|go ahead|participate")  # verbs that name no other deed
_EN_DO = _any("write|provide|produce|generate|create|design|build|make|give|supply|deliver|share|draft|code|implement|develop|complete|finish|fulfil|fulfill|satisfy|answer|support|do|handle|process|take on|take|work on|offer|solve|repair|fix|edit|modify|rewrite|return|output|accept|carry out|perform|discuss|grant|show|send|serve|address|accommodate")
_EN_DOING = _any("writing|providing|producing|generating|creating|designing|building|making|giving|supplying|delivering|sharing|drafting|coding|implementing|developing|completing|fulfilling|answering|doing|handling|processing|taking on|working on|offering|solving|repairing|fixing|editing|helping|assisting|complying")
_EN_DEED = rf"(?:{_EN_FREE}\b|{_EN_DO}(?: (?:me|you|out))? {_EN_OBJECT})"
_EN_CANNOT = _any(
    "can ?not|can't|could not|couldn't|will not|won't|would not|wouldn't|shall not|shan't|must not|mustn't|may not|am not able to|'m not able to|are not able to|am unable to|'m unable to|are unable to|won't be able to|will not be able to|will be unable to"
    "|am not going to|'m not going to|are not going to|am not allowed to|'m not allowed to|am not permitted to|'m not permitted to|am not in a position to|'m not in a position to|am forbidden to|am prohibited from|do not want to|don't want to|do not wish to|prefer not to"
    "|would prefer not to|'d prefer not to|would rather not|'d rather not|had better not|refuse to|decline to|have to decline to|must decline to|must refuse to|have to refuse to|do not feel (?:comfortable|able|free) to|don't feel (?:comfortable|able|free) to"
)
_EN_DECLINE = _any("decline|refuse|abstain|pass on (?:this|that|it)|turn (?:this|that|it|the request|your request) down|say no|reject (?:this|that|it|the request|your request)")
_EN_ME = "(?:i|we)"
_REFUSALS = [
    # English
    rf"\b{_EN_ME}{_EN_ADV} ?{_EN_CANNOT}{_EN_ADV} {_EN_DEED}",
    rf"\b{_EN_ME}{_EN_ADV} ?(?:do not|don't|am not|'m not|would not|wouldn't) (?:feel )?(?:comfortable|able|right|at ease)(?: with)? {_EN_DOING}\b",
    rf"\b{_EN_ME}{_EN_ADV} (?:have to|must|need to|will have to|am going to|will|would|should|am obliged to|am forced to)?{_EN_ADV} ?{_EN_DECLINE}\b",
    rf"\bi(?:'m| am) (?:afraid|sorry|unable|not able|not allowed|not permitted)(?:,? but| that)?(?: i)?(?: {_EN_CANNOT})? {_EN_DEED}",
    rf"\b(?:not |im)possible for (?:me|us) to {_EN_DEED}",
    rf"\b(?:this|that|it|(?:this|that|the|your|such a) {_EN_TASK}) {_any('is|falls|goes|lies|would be')} (?:well |far |clearly )?(?:outside|beyond|not something|not within|nothing)\b[^.!?]{{0,40}}\b(?:i|we) {_any('can|could|may|am able|are able|am allowed|am permitted|am willing|am here')}\b",
    rf"\b(?:this|that|it) is (?:something|a (?:request|task)|one)(?: that| which)? (?:i|we) {_any('must|have to|will|would|should|need to')}{_EN_ADV} {_any('refuse|decline|reject|abstain|pass on|turn down')}",
    rf"\b(?:this|that|it) is (?:something|a (?:request|task)|one)(?: that| which)? (?:i|we) {_any(chr(124).join(['can ?not', 'can.t', 'won.t', 'will not', 'must not', 'may not']))} {_any('do|write|provide|produce|generate|create|design|help with|fulfil|fulfill|answer|accept|support')}\b",
    r"\b(?:my|the|our) (?:answer|reply|response)(?: to (?:this|that|it|your request|the request))?(?: here)? (?:has to be|must be|is|will be|can only be|remains)(?: a)?(?: clear| firm| simple)? no\b",
    rf"\b(?:there (?:will|can) be|you will get|expect|you get) no {_EN_TASK} from (?:my side|our side|me|us)\b|\bfrom (?:my side|our side|me|us) there (?:will|can) be no {_EN_TASK}\b",
    # German
    r"\b(?:ich|wir) (?:kann|können|darf|dürfen|möchte|möchten|werde|werden|will|wollen|soll)\b[^.!?]{0,60}\b(?:nicht|kein\w*)\b[^.!?]{0,40}\b(?:helfen|schreiben|liefern|erstellen|erzeugen|bereitstellen|bearbeiten|erfüllen|nachkommen|entwerfen|beantworten|anbieten|umsetzen|implementieren|ausgeben|übernehmen)\b",
    r"\b(?:kann|können|darf|dürfen|möchte|möchten|werde|werden|will|wollen) (?:ich|wir)\b[^.!?]{0,60}\b(?:nicht|kein\w*)\b[^.!?]{0,40}\b(?:helfen|schreiben|liefern|erstellen|erzeugen|bereitstellen|bearbeiten|erfüllen|nachkommen|entwerfen|beantworten|anbieten|umsetzen|implementieren|ausgeben|übernehmen)\b",
    r"\b(?:darf|kann|möchte|werde|will) (?:ich|wir)\b[^.!?]{0,20}\b(?:nicht|kein\w*) (?:helfen|schreiben|liefern|erstellen|erzeugen|bereitstellen|bearbeiten|erfüllen|entwerfen|beantworten)\b",
    r"\b(?:muss|müssen|möchte|werde) (?:ich|wir)\b[^.!?]{0,40}\b(?:ablehnen|verweigern|verzichten)\b|\b(?:ich|wir) (?:muss|müssen|möchte|werde)\b[^.!?]{0,60}\b(?:ablehnen|verweigern|verzichten)\b|\b(?:ich|wir) (?:lehne|verweigere|lehnen|verweigern)\b[^.!?]{0,60}\b(?:ab|anfrage|aufgabe|wunsch|modul|entwurf|code)\b",
    # French
    r"\b(?:je|nous) (?:ne |n'\s?)(?:peux|pouvons|pourrai|pourrais|vais|veux|dois|suis|souhaite|saurais)\b[^.!?]{0,30}?(?:pas |plus |en mesure de |autorisée? à )[^.!?]{0,30}?\b(?:traiter|écrire|fournir|aider|créer|générer|produire|répondre|réaliser|concevoir|rédiger|donner|proposer|faire|satisfaire|accepter|accéder)\b",
    r"\b(?:je|nous) (?:dois|devons|vais|préfère|souhaite|suis (?:obligée?|contrainte?|contraint) de|me vois (?:obligée?|contrainte?|contraint) de)\b[^.!?]{0,30}\b(?:refuser|décliner|m'abstenir)\b|\b(?:je|nous) (?:refuse|refusons|décline|déclinons|m'abstiens)\b|\bil m'est impossible (?:de |d')[^.!?]{0,20}\b(?:traiter|écrire|fournir|aider|créer|générer|produire|répondre|réaliser|concevoir)",
    # Spanish
    r"\bno (?:puedo|podemos|podré|podría|debo|quiero|voy a|vamos a|me es posible|estoy en condiciones de|estoy autorizad[oa] a|me siento cómod[oa])\b[^.!?]{0,30}?\b(?:ayudar\w*|escribir\w*|proporcionar\w*|crear\w*|generar\w*|producir\w*|responder\w*|realizar\w*|diseñar\w*|dar\w*|ofrecer\w*|atender\w*|cumplir\w*|hacer\w*|entregar\w*|escribiendo|proporcionando)\b",
    r"\b(?:debo|debemos|tengo que|tenemos que|prefiero|he de|voy a)\b[^.!?]{0,20}\b(?:rechazar|declinar|negarme|abstenerme)\b|\bno (?:escribiré|haré|proporcionaré|generaré|crearé|entregaré|diseñaré)\b|\b(?:me niego|nos negamos|rechazo|rechazamos|declino)\b",
    # Portuguese, Italian, Russian, Chinese, Japanese
    r"\bnão (?:posso|vou|consigo|devo) [^.!?]{0,20}?\b(?:ajudar|escrever|fornecer|criar|gerar|produzir|responder|atender|fazer)\b|\b(?:devo|preciso|tenho de) (?:recusar|rejeitar)\b|\bnon (?:posso|sono in grado di|mi è possibile|voglio) [^.!?]{0,20}?\b(?:aiutar\w*|scrivere|fornire|creare|generare|produrre|rispondere|fare)\b|\b(?:devo|preferisco) (?:rifiutare|declinare)\b",
    r"\bя не (?:могу|буду|стану) [^.!?]{0,20}?(?:помо|напис|предостав|созда|выполн|ответ)|\bвынужден\w* отказать|无法(?:提供|帮助|完成|编写)|不能(?:提供|帮助|编写)|(?:お手伝い|対応|提供|作成|生成)(?:は|を)?(?:いた)?(?:でき|し)ません|お断り",
]
_REFUSAL = re.compile("|".join(_REFUSALS))
# what every refusal holds; spares the grammar for most answers
_REFUSAL_HINT = re.compile(r"n't|not\b|unable|possible|declin|refus|reject|abstain|pass on|say no|\bno\b|outside|beyond|nothing|forbid|prohib|kein|nicht|ablehn|lehne|verweig|verzicht|\bne\b|\bn'|abst|declin|niego|negar|rechaz|não|non\b|recus|rejeit|rifiut|не |отказ|无法|不能|ません|断り")


def is_refusal(prose: str) -> bool:
    """A prose answer of any length in which the writer declines."""
    low = " ".join(prose.lower().replace("’", "'").replace(",", " ").split())
    return _REFUSAL_HINT.search(low) is not None and _REFUSAL.search(low) is not None


# ------------------------------------------------------------------ copy

_TOKEN = re.compile(r"\w+|[^\w\s]")
GREETING = 12  # tokens before a copy that count as a greeting
CLOSING = 4  # tokens after it
TILE = 3  # tokens of the shortest tile
HEAD = 1500  # characters of an answer that are looked at first; all of it where they may be a copy
_FENCE_MARK = re.compile(r"(?:`{3,}|~{3,})[\w+#.-]*")
_HEADING = re.compile(r"^#+ [^\n]*$", re.M)


def tokens_of(text: str) -> list[str]:
    """Words and marks in lower case; fences are no part of a text, wherever a change of spacing has put them."""
    low = text.lower()
    return _TOKEN.findall(_FENCE_MARK.sub(" ", low) if "```" in low or "~~~" in low else low)


def question_parts(question: str) -> list[list[str]]:
    """Token lists of what a copy may give back: the question, its specification (each section), its code, its text without code."""
    texts = [question]
    prose, blocks, _ = split_text(question)
    texts += [c for c, _ in blocks] + [prose]
    heads = list(_HEADING.finditer(question))
    if heads:
        texts.append(question[heads[0].start() :])
        texts.append(prose[: prose.find(heads[0][0])] if heads[0][0] in prose else "")
    for k, h in enumerate(heads):
        end = heads[k + 1].start() if k + 1 < len(heads) else len(question)
        texts += [question[h.start() : end], question[h.end() : end]]
    return [t for t in map(tokens_of, texts) if len(t) >= 4]


Suffixes = tuple[list[dict[str, int]], list[int], list[int], list[int]]


def suffixes_of(b: list[str]) -> Suffixes:
    """The suffix automaton of a token list: steps, links, longest lengths and first ends of its states."""
    step: list[dict[str, int]] = [{}]
    link, size, end = [-1], [0], [-1]
    last = 0
    for k, t in enumerate(b):
        new = len(step)
        step.append({})
        size.append(size[last] + 1)
        end.append(k)
        link.append(0)
        p = last
        while p >= 0 and t not in step[p]:
            step[p][t] = new
            p = link[p]
        if p >= 0:
            q = step[p][t]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                end.append(end[q])
                link.append(link[q])
                while p >= 0 and step[p].get(t) == q:
                    step[p][t] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step, link, size, end


def common_runs(a: list[str], b: Suffixes) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the runs of a that occur in b and can't be longer, each at one place of b; linear in a, whatever is repeated."""
    step, link, size, end = b
    out, at, n = [], 0, 0
    for k, t in enumerate(a):
        if t not in step[at] and n >= TILE:
            out.append((k - n, end[at] - n + 1, n))
        while at and t not in step[at]:
            at = link[at]
            n = size[at]
        if t in step[at]:
            at, n = step[at][t], n + 1
    if n >= TILE:
        out.append((len(a) - n, end[at] - n + 1, n))
    return out


def greedy_tiles(a: list[str], b: list[str], suffixes: Suffixes | None = None) -> list[tuple[int, int, int]]:
    """Tiles (place in a, place in b, length) of greedy string tiling: the longest common runs first, no token in two tiles; what is left of a run that overlaps a tile waits for its turn."""
    runs = [(-n, i, j) for i, j, n in common_runs(a, suffixes or suffixes_of(b))]
    heapq.heapify(runs)
    used_a, used_b, tiles = bytearray(len(a)), bytearray(len(b)), []
    while runs:
        n, i, j = heapq.heappop(runs)
        n = -n
        free = _free_runs(used_a, used_b, i, j, n)
        if free == [(i, j, n)]:
            used_a[i : i + n] = used_b[j : j + n] = b"\1" * n
            tiles.append((i, j, n))
        else:
            for x, y, m in free:
                heapq.heappush(runs, (-m, x, y))
    return tiles


def _free_runs(used_a: bytearray, used_b: bytearray, i: int, j: int, n: int) -> list[tuple[int, int, int]]:
    """The parts of a run that lie in no tile on either side."""
    out, start = [], None
    for k in range(n + 1):
        if k < n and not used_a[i + k] and not used_b[j + k]:
            start = k if start is None else start
        elif start is not None:
            if k - start >= TILE:
                out.append((i + start, j + start, k - start))
            start = None
    return out


def untiled(given: list[str], question: list[str], enough: int = 0) -> int:
    """Tokens of the answer that no tile covers.  Tiling goes on with what is left, so that a part of the question may be given back twice, until at most ``enough`` are left."""
    rest, suffixes = given, suffixes_of(question)
    while len(rest) > enough:
        covered = bytearray(len(rest))
        for i, _, n in greedy_tiles(rest, question, suffixes):
            covered[i : i + n] = b"\1" * n
        if not any(covered):
            break
        rest = [t for t, c in zip(rest, covered, strict=True) if not c]
    return len(rest)


def tiled(given: list[str], parts: list[list[str]]) -> bool:
    """Whether the tokens are a greeting at most and then tiles that are each a whole part, with at most 4 tokens after the last."""
    by_first: dict[str, list[list[str]]] = {}
    for part in parts:
        by_first.setdefault(part[0], []).append(part)
    reached, ends = set(range(GREETING + 1)), set()
    for i in range(len(given)):
        if i not in reached:
            continue
        for part in by_first.get(given[i], ()):
            end = i + len(part)
            if end not in ends and given[i:end] == part:
                if len(given) - end <= CLOSING:
                    return True
                ends.add(end)
        reached |= ends
    return False


def is_copy(question: str | None, answer: str) -> bool:
    """Whether the answer is a greeting at most and then the question or whole parts of it.

    Greedy string tiling tells whether the answer has anything of its own; tiles
    count if together they are whole parts.  What no tiling can cover is found
    by cheaper tests first: tokens, then runs of ``TILE`` tokens, that the question lacks.
    """
    if not question:
        return False
    most = GREETING + CLOSING  # more than that no tiling may leave
    asked_text, head = question.lower(), answer[:HEAD]
    if sum(t not in asked_text for t in set(tokens_of(head))) > most + 1:  # the last token may be cut
        return False
    given = tokens_of(answer)
    if len(given) < 4:
        return False
    asked = tokens_of(question)
    known = set(asked)
    if len(set(given) - known) > most or sum(t not in known for t in given) > most:
        return False
    runs = set(zip(*(asked[k:] for k in range(TILE)), strict=False))
    covered = bytearray(len(given))
    for k, run in enumerate(zip(*(given[k:] for k in range(TILE)), strict=False)):
        if run in runs:
            covered[k : k + TILE] = b"\1" * TILE
    if covered.count(0) > most:
        return False
    return untiled(given, asked, most) <= most and tiled(given, question_parts(question))


# ------------------------------------------------------------------ language

# Frequent function words by language, and scripts that tell a language.
WORDS = {
    "en": "the a an is are and of to in that it with for this be by on as at from when which not while before after has have so was were or must will its you we i can does what here block module",
    "de": "der die das ein eine und ist sind nicht mit auf für den dem des von zu im wird werden während sobald nach bei sich als auch wenn dass bitte wir ich hier unten nur noch steht bleibt bis erst darf solange dieser diese dieses was macht wie warum welche erkläre",
    "fr": "le la les un une des et est sont ne pas pour dans que qui avec sur du au aux par ce cette ces nous il tant après avant pendant vaut voici ci ont été selon sa son reste faut seulement je merci",
    "es": "el la los las un una y es son no para en que con por del al se lo su hasta mientras tras esté está este esta esta debe queda vale nosotros aquí aparecieron sólo solo después según siguiente permanece observamos qué hace cómo explica cuál por",
    "pt": "o a os as um uma e é são não para em que com por do da dos das no na nos nas ao se até enquanto depois fica está são aqui então pedido módulo vale seu sua deve apenas",
    "it": "il lo la i gli le un uno una e è sono non per in che con di del della dei delle al alla si finché dopo viene rimane quindi ecco questo questa deve mentre solo durante più modulo richiesto",
    "nl": "de het een en is zijn niet met voor op van te dat die dit wordt worden als ook tot na bij deze hier moet geen wij ik terwijl alleen",
    "pl": "i w na z do nie jest są się że to dla po od jak przez oraz przy tylko jeśli który moduł gdy podczas zostaje",
    "sv": "och är en ett det som att på för inte med av till den när från har om efter innan medan ska kan vi här",
    "cs": "a je se na v že pro nebo po při když není jsou ze do od modul tak jen jako",
    "tr": "ve bir bu için ile olarak değil daha sonra kadar olan gibi ise her çok modül",
}
_WORDS = {k: frozenset(v.split()) for k, v in WORDS.items()}
_LANGUAGES_OF = {w: tuple(k for k, v in _WORDS.items() if w in v) for v in _WORDS.values() for w in v}
_SCRIPTS = [
    ("ru", re.compile(r"[Ѐ-ӿ]")), ("el", re.compile(r"[Ͱ-Ͽ]")), ("ja", re.compile(r"[぀-ヿ]")), ("zh", re.compile(r"[一-鿿]")),
    ("ko", re.compile(r"[가-힯]")), ("ar", re.compile(r"[؀-ۿ]")), ("he", re.compile(r"[֐-׿]")), ("hi", re.compile(r"[ऀ-ॿ]")), ("th", re.compile(r"[฀-๿]")),
]
_OWN_SCRIPT = dict(_SCRIPTS)
_CODE_SPAN = re.compile(r"`[^`\n]*`|https?://\S+")
_RUN = re.compile(r"\w+")


def language_of(prose: str) -> str | None:
    """The language of a piece of prose; None if it tells too little."""
    text = _CODE_SPAN.sub(" ", prose) if "`" in prose or "://" in prose else prose
    # identifiers, told by digits, underscores and inner capitals, are no words
    words = [w for w in _RUN.findall(text) if w.isalpha() and (w.islower() or not w[0].islower())]
    letters = sum(map(len, words))
    if letters < 8:
        return None
    if not text.isascii():
        for lang, script in _SCRIPTS:
            if sum(map(len, script.findall(" ".join(words)))) * 10 >= letters * 4:
                return lang
    words = [w.lower() for w in words]
    score = dict.fromkeys(_WORDS, 0)
    for w in words:
        for k in _LANGUAGES_OF.get(w, ()):
            score[k] += 1
    best = max(score, key=score.__getitem__)
    rest = max(v for k, v in score.items() if k != best)
    if score[best] < 2 or score[best] * 10 < len(words) or (score[best] - rest) * 8 < score[best]:
        return None
    return best


def in_other_language(question: str | None, prose: str) -> bool:
    if not question or len(prose.strip()) < 12:
        return False
    answer = language_of(prose)
    if answer is None:
        return False
    prose = split_text(question)[0]
    asked = language_of(prose)
    if asked is None:  # too few words to tell; another script tells nevertheless
        return answer in _OWN_SCRIPT and sum(c.isascii() and c.isalpha() for c in prose) >= 8 and not _OWN_SCRIPT[answer].search(prose)
    return asked != answer


# ------------------------------------------------------------------ operator


_LEADING = re.compile(r"(?:\s+|//[^\n]*|/\*[\s\S]*?\*/)*+")
_COMMENTS = re.compile(r"//([^\n]*)|/\*([\s\S]*?)\*/")


def said(parts: tuple[str, list[tuple[str, bool]], bool]) -> str | None:
    """What an answer without code says: its prose, or comments where it has no more; None if it has code."""
    prose, blocks, _ = parts
    out = [prose]
    for code, _ in blocks:
        if _LEADING.match(code).end() < len(code):
            return None
        out += [a or b for a, b in _COMMENTS.findall(code)]
    return " ".join(out)


def defect_of(question: str | None, answer: str | None) -> str | None:
    """The defect of a pair, None if it has none."""
    if is_empty(answer):
        return "empty"
    parts = split_text(answer)
    words = said(parts)
    if words is not None and is_refusal(words):
        return "refusal"
    if is_copy(question, answer) or (parts[1] and words is not None and is_copy(question, words)):
        return "copy"
    if in_other_language(question, parts[0]):
        return "other_language"
    return "truncated" if truncated(answer, parts) else None


def sample_defects(messages: list[dict] | None) -> Iterator[tuple[int, str]]:
    """(pair_no, defect) of a sample's defective pairs."""
    n = 0
    messages = messages or []
    for k, m in enumerate(messages):
        if not m or m.get("role") != "user":
            continue
        n += 1
        reply = messages[k + 1] if k + 1 < len(messages) else None
        answer = reply.get("content") if reply and reply.get("role") == "assistant" else None
        d = defect_of(m.get("content"), answer)
        if d:
            yield n, d


def pair_defects(samples: DataFrame) -> DataFrame:
    """(sample_id, pair_no, defect) of all defective pairs.  Narrow but for the distinct of the few results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, d) for i, ms in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, d in sample_defects(ms)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())],
                names=["sample_id", "pair_no", "defect"],
            )

    return samples.select(F.col("sample_id").cast("long"), "messages").mapInArrow(run, "sample_id long, pair_no int, defect string").distinct()


def defect_rates(samples: DataFrame) -> DataFrame:
    """Pairs and defects of each kind by task type."""
    users = F.size(F.filter("messages", lambda m: m["role"] == "user"))
    # only the number of pairs is compared and shuffled, not the messages
    each = samples.select("sample_id", "task_type", F.when(F.col("messages").isNull(), 0).otherwise(users).alias("n")).distinct()
    total = each.groupBy("task_type").agg(F.sum("n").alias("n_pairs"))
    found = pair_defects(samples).join(each.select("sample_id", "task_type"), "sample_id").groupBy("task_type", "defect").agg(F.count("*").alias("n_defective"))
    return total.join(found, total["task_type"].eqNullSafe(found["task_type"]), "left").select(total["task_type"], "defect", "n_pairs", F.coalesce("n_defective", F.lit(0)).alias("n_defective"))
