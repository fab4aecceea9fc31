"""Made-up documents with the places of their mentions, for fitting the field of :mod:`kilnspark.llm.pii`.

Names are put together from syllables, numbers from public number formats, and
sentences are written for this module: notes, mails, tickets, forms and code
with persons, and texts with things that look like them.  A seed makes them.
"""

from __future__ import annotations

import random
import re

# Function words and words that open sentences or titles, which are no names.
COMMON = frozenset(
    """the a an as if in on at to by for from with and or of it its this that these those when while once after before during until each every
    any all no not nobody we you he she they i our your my his her their is are was were be been has have had do does did can could will would
    may must should assume whenever keep use see call ask please write read send ship run set get put let then there here what which who how why
    so but than only also still both two three one first second last next new old more most some such same other into over under about above below
    between without within because since though per via yes ok done note todo fixme author owner contact reviewer reviewed reported report signed
    off hi hello dear best regards thanks thank cheers kind sincerely cc to subject re fwd date name phone tel mobile fax email mail address
    id number question answer issue ticket badge request board boards kit sample package reset clock input output value signal bench test
    synthesis saturation latency error warning info file line part lot serial order seed commit build version section table figure step backup maintainer
    assigned approved checked verified january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday
    le la les un une des du de au aux il elle nous vous ils elles on ce cette ces son sa ses leur et ou mais donc car ne pas plus est sont été comme après avant lors pendant
    pour par sur sous dans avec sans selon merci bonjour cordialement voici si tant bien très deuxième premier signalé écrit
    el los las unos unas y o pero porque que se su sus es son fue ha han al del tras mientras durante desde hasta en puede como por para según hola gracias saludos sin con no sí esta este ese
    der die das ein eine einen einem den dem des im am zum zur und oder aber bei nach vor während wenn sobald für mit von vom wie als wir ich sie es er ihr ihre sein seine ist sind war
    wird werden hat haben nicht kein keine auf aus um bis durch ohne bitte hallo danke grüße viele beste hier dort auch nur noch schon""".split()
)
# Words of streets.
ROADS = frozenset(
    """street st road rd avenue ave lane ln drive dr court ct close way place pl square sq terrace crescent boulevard blvd parkway row walk gardens grove mews
    rue allée impasse chemin quai cours route calle avenida avda plaza paseo camino carrera weg str straße strasse gasse platz ring damm ufer allee""".split()
)
# Words of parts of houses, which begin an address.
FLATS = frozenset("flat apt apartment suite appt appartement piso wohnung".split())
# Nouns of what is named after somebody but is no person.
THINGS = frozenset(
    """adder multiplier counter encoder decoder tree register machine stage filter buffer parser detector arbiter receiver divider stretcher transmitter
    table mux unit field code pointer scoreboard generator shifter logic fifo level distance recoding algorithm cipher theorem sequence filters method rule
    transform mode state stack queue channel codes bridge law effect module design core bus protocol lemma diagram model test index constant number series
    conjecture award prize institute project team board release street view automaton form notation zähler addierer speicher automat compteur additionneur machine contador sumador
    baum kodierer dekodierer filter matrix function equation paradox principle curve""".split()
)
# What follows a number that is a quantity.
UNITS = frozenset("ns us ps ms s mhz ghz khz hz bit bits byte bytes kb mb gb cycles cycle cells ticks ma mv v lines words rows samples takte ciclos octets".split())

_SYLL = "ba be bren bri cal cor da del dor dra el es fa fen ga gri ha hol il in jo ka kel la lin lo ma mar mi mor na nel ni no o or pa pel pi qui ra ren ri ro sa sel sto ta tor tri ul va ven vi wen wil xa ya zo é ö ü ñi ø".split()
_ENDS = ["", "n", "s", "th", "k", "ley", "ton", "wick", "field", "son", "er", "mann", "ez", "eau", "ska", "o", "a", "well"]


def made(r: random.Random, n: int = 2) -> str:
    return ("".join(r.choice(_SYLL) for _ in range(r.randint(max(1, n - 1), n))) + r.choice(_ENDS)).capitalize()


class Person:
    def __init__(self, r: random.Random):
        self.given, self.family = made(r), made(r)
        if r.random() < 0.15:
            self.family += "-" + made(r)
        elif r.random() < 0.05:
            self.family = r.choice(["van ", "de la ", "von ", "O'", "Mc", "di "]) + self.family
        self.middle = chr(65 + r.randrange(26))

    def form(self, r: random.Random) -> str:
        x = r.random()
        if x < 0.2:
            return f"{self.given[0]}. {self.family}"
        if x < 0.35:
            return f"{self.family}, {self.given}"
        if x < 0.4:
            return f"{self.family}, {self.given[0]}."
        return f"{self.given} {self.middle}. {self.family}" if x < 0.52 else f"{self.given} {self.family}"


def digits(r: random.Random, form: str) -> str:
    """9 is any digit, A any capital, f any hexadecimal digit."""
    return "".join(str(r.randrange(10)) if c == "9" else chr(65 + r.randrange(26)) if c == "A" else r.choice("0123456789abcdef") if c == "f" else c for c in form)


PHONES = (
    "+1 999 999 9999|+1-999-999-9999|+19999999999|(999) 999-9999|999.999.9999|999-999-9999|999 999 9999|+44 20 9999 9999|+44 9999 999999|020 9999 9999|09999 999999|+49 99 99999 999|+49 999 9999999|099/99999-999|0999 9999999|0049 99 99999999"
    "|+33 9 99 99 99 99|0033 9 99 99 99 99|09.99.99.99.99|09 99 99 99 99|+34 999 999 999|699 999 999|699 99 99 99|0099 99 9999999|+39 99 9999 9999|+41 99 999 99 99"
).split("|")
IDS = "999-99-9999|999 99 9999|AA9999999|A99999999|9 99 99 99 999 999 99|1 99 13 99 999 999 99|2 99 09 99 999 999 99|99 999 999 999|99999999999|99999999A|99999999-A|A9A999999|L9A999999|X9999999A|Y-9999999-A|999999999|99AA99999".split("|")
LABELS = (
    "SSN|SSN:|social security no.|social security number:|social security number|passport|passport no.|passport number:|n° de sécurité sociale|numéro de sécurité sociale :|numéro fiscal|passeport n°|carte d'identité|Steuer-ID|Steuer-ID:|Steuernummer|Personalausweis|Ausweisnummer|Reisepass Nr."
    "|DNI|DNI:|NIE|NIF|pasaporte|número de la seguridad social|tax id|tax number:|TIN|identity card|ID card no.|national insurance no."
).split("|")
_HOSTS = ["com", "org", "net", "example", "test", "invalid", "io", "de", "fr", "co.uk", "edu"]


def _mail(r: random.Random, p: Person) -> str:
    g, f = p.given.lower(), re.sub(r"\W", "", p.family.lower())
    f2 = r.choice([f, f, f"{f}-{made(r).lower()}"])
    user = r.choice([f"{g}.{f2}", f"{g}_{f2}", f"{g[0]}{f2}", f"{f2}{r.randrange(100)}", f"{g}.{f}", f"{g}_{f}", f"{g[0]}{f}", f"{f}.{g[0]}", f"{f}{r.randrange(100)}", f"{g}+{r.choice(['rtl', 'list', 'dev'])}", f"{r.choice(['info', 'desk', 'office', made(r).lower(), made(r, 1).lower()])}{r.randrange(r.choice([10, 100]))}", f"{f}-{g}"])
    host = f"{r.choice(['', '', 'mail.', 'lab.', 'eng.'])}{made(r).lower()}.{r.choice(_HOSTS)}"
    x = r.random()
    if x < 0.5:
        return f"{user}@{host}"
    if x < 0.59:
        return f"{user}@{host}".upper()
    at = r.choice([" at ", " at ", " [at] ", "(at)", " (at) ", "[at]", " AT ", " {at} ", "＠", " @ "])
    dot = r.choice([" dot ", " dot ", " [dot] ", "[dot]", "(dot)", ".", ".", " DOT "]) if at.strip() not in ("＠", "@") else "."
    return f"{user.replace('.', dot) if r.random() < 0.3 else user}{at}{host.replace('.', dot)}"


def _city(r: random.Random) -> str:
    return r.choice(["{}", "{}", "{}", "Saint-{}", "San {}", "Bad {}", "{}-sur-{}", "{} am {}", "{} upon {}"]).replace("{}", "\0").replace("\0", made(r), 1).replace("\0", made(r))


def _address(r: random.Random) -> str:
    no, n, z = str(r.randint(1, r.choice([9, 99, 260]))), made(r), digits(r, "99999")
    no += r.choice(["", "", "", "", "a", "b", "B"])
    road = r.choice(["Street", "St.", "Road", "Rd.", "Avenue", "Ave.", "Ave", "Lane", "Drive", "Court", "Close", "Way", "Place", "Square", "Terrace", "Crescent", "Boulevard"])
    flat = r.choice(["", "", "", f"Flat {r.randint(1, 20)}, ", f"Apt. {r.randint(1, 20)}, ", f"Unit {r.randint(1, 20)}, ", f"Apartment {r.randint(1, 20)}B, "])
    x = r.random()
    if x < 0.42:
        return f"{flat}{no} {n} {road}" + r.choice(["", "", f", {_city(r)}", f", {_city(r)} {z}", f", {_city(r)}, {z}"])
    if x < 0.6:
        kind = r.choice(["rue", "rue", "rue", "avenue", "boulevard", "place", "allée", "impasse", "quai", "chemin"])
        return f"{no}{r.choice(['', '', ' bis', ' ter'])}{r.choice(['', '', ','])} {kind} {r.choice(['de la ', 'de la ', 'du ', 'des ', 'de ', ''])}{n}" + r.choice([f", {z} {_city(r)}", f", {z} {_city(r)}", ""])
    if x < 0.75:
        return f"{r.choice(['Calle', 'Calle', 'Avenida', 'Plaza', 'Paseo', 'C/'])} {r.choice(['', '', 'de la ', 'del '])}{n} {no}" + r.choice([f", {z} {_city(r)}", ""])
    return f"{n}{r.choice(['straße', 'str.', 'weg', 'gasse', 'allee', 'platz', 'strasse', 'ring'])} {no}" + r.choice([f", {z} {_city(r)}", f", {z} {_city(r)}", ""])


# {v} any word, {N} a noun before a number, {P} person, {E} mail, {T} phone, {A} address, {L} label and number of a person, {X} name of a thing, {n} identifier, {#..} digits.
FRAMES = [
    "Author: {P}", "Author: {P} <{E}>", "# author {P}, {E}", "// written by {P} ({E})", "/* Copyright {#2099} {P} */", "/* (C) {#2099} by {P}, {E} */", "// {#2099} {P}, {E}", "{P}, {E}, {T}", "{\"mail\": \"{E}\", \"name\": \"{P}\"}", "mail={E} width={#99}", "-- maintainer : {P}", "Maintained by {P} and {P}.", "Owner is {P}; deputy: {P}", "owner = \"{P}\"", "{\"name\": \"{P}\", \"mail\": \"{E}\", \"n\": {#99}}",
    "Acked-by: {P} <{E}>", "Tested-by: {P} <{E}>", "Co-developed-by: {P} <{E}>", "Reviewer: {P}", "Reviewers: {P}, then {P}.", "Approved by {P} on {#2099-09-19}.", "Found by {P} in run {#99}.", "Thanks go to {P} for the trace.", "With help from {P} and {P}. It now locks.", "Minutes by {P} and {P}. Next call on Friday.",
    "As {P} said, the margin is thin.", "As {P} {v} {v}, the margin is thin.", "As {P} {v}, {n} is late.", "Wie {P} {v}, war {n} zu spät.", "Comme {P} l'a {v}, c'est trop tard.", "Comme {P} {v}, {n} manque.", "Como {P} {v}, {n} llega tarde.", "Reported by {P} and {P}, {v} by {P}.", "{P} {v}: see {n}", "Von {P} {v}.", "Vu par {P}.", "Visto por {P}.", "As {P} explained in the call, the bound moves.", "According to {P}, this path is false.", "{P} asked: is it late?", "{P} wrote: please look at {n}", "{P} replied that {n} is stable.", "{P} suggests a deeper queue.", "Talk to {P} first.", "Assigned to {P}.", "Hi {P},", "Dear {P},", "Hello {P}!",
    "Regards,\n{P}", "Kind regards,\n{P}\n{A}", "Cheers,\n{P}\n{T}", "\n-- \n{P}\n{E}", "\n--\n{P}\n{A}\nphone {T}\n{E}", "{P}\n{A}\n{T}", "| {P} | {T} | {#99} |", "| {P} | {E} | open |", "{P}; {T}; {E}", "{P} ({T})", "{P} - {E}",
    "Please grant {P} access, {L}.", "Access card for {P}, {L}.", "Visitor {P}, {L}, arrives at nine.", "The form gives {L}.", "On the form: {L}.", "Copy of {L} is attached.", "{L}", "Payroll needs {L} of {P}.",
    "Phone me at {T}.", "Call {T} after lunch.", "Call us on {T} before six.", "Calls to {T} go to the desk.", "My number is {T}, ask for {P}.", "Phone: {T}", "tel. {T}", "Mobile {T}, evenings only.", "You can reach me under {T} until noon.", "Ring {T} when it fails again.", "Fax {T}", "Support line {T} is staffed.", "The spare board is at {P}'s desk ({T}).", "The probe is with {P} ({T}), fetch it at {A}.", "The scope went to {P}, {A}.",
    "Deliver to {A}.", "Deliver the boards to {P}, {A}.", "Ship it to {A} by Monday.", "Our lab is at {A}.", "Pick up: {A}", "Address: {A}", "Return to {A}, thanks.", "Mail {E} with the log.", "Mail the log to {E} before noon.", "Contact: {E}", "Contact {P} at {E}.", "cc {E}", "To: {E}, {E}", "CC: {E}; {E}", "Bugs to {E}.", "<{E}>",
    "Autor: {P}", "Verfasst von {P}.", "Gemeldet hat es {P} am Montag.", "Laut {P} ist der Pfad zu lang.", "Wie {P} schrieb, fehlt ein Takt.", "Wie {P} sagte, stimmt das nicht.", "{P} schreibt: bitte prüfen", "{P} meinte, es geht.", "Viele Grüße\n{P}", "Anruf bitte unter {T}.", "Rückfragen an {P}, Telefon {T}.", "Bitte an {A} liefern.", "Die Karte liegt in {A}.", "Mail an {E} genügt.", "Im Antrag steht {L}.", "Ausweis für {P}, {L}.",
    "Auteur : {P}", "Rédigé par {P}.", "Trouvé par {P} hier.", "Selon {P}, le chemin est faux.", "Comme {P} l'a dit, il manque un cycle.", "{P} écrit : à revoir", "{P} a répondu : non", "Cordialement,\n{P}", "Appelez le {T} avant midi.", "Tél. {T}", "Livrer à {A}.", "Le banc se trouve au {A}.", "Écrire à {E} pour la suite.", "Le dossier donne {L}.", "Carte d'accès pour {P}, {L}.",
    "Autora: {P}", "Escrito por {P}.", "Lo encontró {P} ayer.", "Según {P}, falta un ciclo.", "Como {P} dijo, el margen es poco.", "{P} escribe: revisar", "{P} respondió: sí", "{P} escribió que {n} falla.", "{P} anotó: {n}", "{P} escribió esto: ver {n}", "Llevar el equipo a {A}.", "Mandar las muestras a {A} el lunes.", "Expédier le banc au {A}.", "Porter le tout à {A}, merci.", "Saludos,\n{P}", "Mi teléfono es {T}.", "Avisar al {T} antes de las dos.", "Entregar en {A}.", "El equipo está en {A}.", "Escribir a {E} con el registro.", "La ficha indica {L}.", "Acceso para {P}, {L}.",
]
PLAIN = [
    "The {X} adder is slower than the {X}-{X} one.", "A {X} counter drives {n}.", "It needs a {X}-{X} adder for {n}.", "a {X}-{X} multiplier with {#9} stages", "{n}: use a {X}-{X} decoder here", "For {n}, take the {X} filter.", "{n}, Then {n} falls.", "Use a {X} {X} tree for {n}.", "the {X} code of {n}", "After the {X} filter comes a {X} decoder.", "See the {X} {X} theorem for a proof.", "The {X} {X} bridge is closed.", "{X} {X} Award", "{X} Street View mode is off.", "The {X} Lane project uses {X} State logic.", "Drive strength is {#9} mA, lane {#9} is idle.", "The {X} transform and the {X} sequence agree.",
    "{X} {#99}, {X} {#9}", "{N} {#99}, then {N} {#9}.", "den {N} {#99}, sobald {n} steigt", "{N} {#9} of {#99}", "nach {N} {#999}, vor {N} {#999}", "la {N} {#99}, si {n} sube", "The {X} {v} and the {X} {v} agree.", "Every {X} {v} is slow.", "A {X} machine with {#99} states.", "Every {X} cipher needs a key.", "{X} {X} Design Review", "# {X} {X} Module", "## Test Plan", "## {X} Stage Overview", "Der {X} Zähler läuft.", "Ein {X}-{X}-Addierer genügt.", "Nach dem Test Wert {#99} lesen.", "Die Breite Bit {#9} bleibt.", "Le compteur {X} est remis.", "La Machine {X} attend.", "Un codage {X} suffit.", "El contador {X} sube.", "Un sumador {X}-{X} basta.", "La Tabla {X} se lee.",
    "Word at {#0x99999999}, lane {#9}, row {#99}.", "port {#9}, lane {#99}, way {#9} of {#9}", "place {#9} in row {#99}; drive {#99} mA", "lane {#9} drive {#9}", "park in lane {#9}", "Random start {#9999999999}, took {#9 999 999} ns.", "It ran {#999 999 999} ns and used {#99 999 999} bytes.", "Part {#AA-99999-9999}, batch {#999999999}.", "Lot {#999999999} passed all steps.", "serial {#999 999 999} was scrapped", "Order {#9999999999} left on {#2099-09-19}.", "Server {#192.168.99.99}:{#9999} is up.", "Host {#10.9.99.999} port {#99999}", "Bug {#99999}, build {#9.99.999}.", "As in IEEE {#9999}-{#2099}, clause {#99.9.9}.", "ISO {#9999}-{#9}:{#2099}", "Base {#0x99999999}, size {#99999999}.", "commit {#ffffffff}{#fffffff} landed", "sha {#fffffff}", "hash {#9fff9fff}{#ff99ff99}", "{#2099-09-19} {#10:99:99} done", "{#2099-09-19} {#10:99:99},{#999} - run.{n} - INFO - ok", "[{#99999999}] tick", "seed={#999999999}", "count {#999999999} cycles", "offset {#99999999} of {#999999999}", "checksum {#99999999}", "v{#9.9.9}", "{#99} / {#99} passed", "{#99.99}ns INFO {n} up", "ISBN {#999-9-999-99999-9}", "Case {#999999-9999}", "width {#99}, depth {#9999}", "ratio {#9.9999999}", "Want {#999}, have {#9999}", "Mismatch: Wanted {#999}, Saw {#999}", "Total {#99}, Failed {#9}", "Step {#9}: Width {#99}, Depth {#999}", "UUID {#ffffffff-ffff-9fff-ffff-ffffffffffff}",
    "always @(posedge {n}) begin", "@cocotb.test()", "@property", "assign {n} = {n} & {#9}'h{#99};", "input wire [{#99}:0] {n},", "module {n} #(parameter W = {#99}) (", "`timescale 1ns/1ps", "if ({n} == {#99}'d{#9999}) {n} <= {n} + 1;", "localparam IDLE = {#9}'d{#9}, RUN = {#9}'d{#9};", "foo(a, b)[{#9}] = x.y;", "price at {#99.99} per unit", "Look at {n}. It toggles.", "It stops at once. See below.", "meet at noon. Then go.", "sampled at {#99} MHz dot clock",
    "The output of {n} has to settle before {n} moves.", "Nothing changes while {n} is low.", "When {n} rises, {n} is cleared.", "It is still open whether {n} may stall.", "All of it fits into {#999} cells.", "No more than {#99} entries are kept.", "Both ports are read in one step.", "Please rerun it with {#99} seeds.", "Second run: {#999} samples, no error.", "Hi all,", "Dear team,", "Best,", "Thanks!", "Regards,", "- Item one\n- Item two", "| Name | Phone | State |", "| Block | Width | OK |", "Open Points", "Release Notes", "Known Issues", "Change Log", "Next Steps", "Monday Meeting", "In March we move to Version {#9}.",
    "Während {n} aktiv ist, wartet der Block.", "Die Prüfung dauert {#99} Takte.", "Sobald {n} steigt, wird {n} leer.", "Bitte den Lauf mit {#99} Werten wiederholen.", "Quand {n} monte, {n} est vidé.", "Il reste {#99} cycles.", "La sortie ne change pas tant que {n} dure.", "Cuando {n} sube, {n} queda vacío.", "Quedan {#99} ciclos.", "La salida no cambia mientras {n} siga alto.",
]
_SLOT = re.compile(r"\{(#[^}]*|[PETALXnvN])\}")
_NOUNS = "Chapter Section Figure Table Page Level Phase Round Slot Bank Row Port Channel Rev Tag Wert Stufe Seite Kapitel Zeile Spalte Kanal Bild Teil Takt Page Valeur Étape Ligne Canal Bloc Valor Etapa Fila Nivel Paso Expected Actual Total".split()


def _filled(r: random.Random, frame: str, people: list[Person], things: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
    out, gold, at = "", [], 0
    for m in _SLOT.finditer(frame):
        out += frame[at : m.start()]
        at = m.end()
        s = m[1]
        who = r.choice(people)
        if s[0] == "#":
            out += digits(r, s[1:])
            continue
        if s == "n":
            out += r.choice(["rx", "tx", "cfg", "mem", "dma", "clk", "req"]) + r.choice(["_", "Ack", "_cnt_", ""]) + r.choice(["q", "ff", "en", "val", "ready", "d3"])
            continue
        if s in "XvN":
            out += r.choice(things) if s == "X" else made(r).lower() if s == "v" else r.choice(_NOUNS)
            continue
        if s == "L":
            out += r.choice(LABELS) + " "
            text, kind = digits(r, r.choice(IDS)), "id_number"
        else:
            text, kind = {"P": lambda: (who.form(r), "person"), "E": lambda: (_mail(r, who), "email"), "T": lambda: (digits(r, r.choice(PHONES)), "phone"), "A": lambda: (_address(r), "address")}[s]()
        gold.append((len(out), len(out) + len(text), kind))
        out += text
    return out + frame[at:], gold


def training_documents(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` documents of a few frames, and the spans of their mentions; persons and things come back within a document.

    A line with nothing but a person or a thing tells which of them it is only by its other places.
    """
    r = random.Random(seed)
    docs = []
    for _ in range(n):
        people, things = [Person(r) for _ in range(r.randint(1, 2))], [made(r) for _ in range(2)]
        text, gold = "", []
        for _ in range(r.randint(3, 8)):
            x = r.random()
            if x < 0.06:
                piece, g = f"\n{people[0].given} {people[0].family}\n", []
                g = [(1, len(piece) - 1, "person")]
            elif x < 0.12:
                piece, g = f"\n{things[0]} {things[1]}\n", []
            else:
                piece, g = _filled(r, r.choice(FRAMES if x < 0.56 else PLAIN), people, things)
                if not g and r.random() < 0.08:
                    piece = piece.upper()
            gold += [(len(text) + a, len(text) + b, k) for a, b, k in g]
            text += piece + r.choice([" ", " ", "\n", "\n\n", "\r\n"])
        docs.append((text, gold))
    return docs
