"""Token rules and grammars of the languages that source files are checked as.

The grammars follow the syntax annexes of the public language standards.  They
describe syntax only: names need no declaration, widths and types no sense.
"""

from __future__ import annotations

# Reserved words of Verilog-2005.
VERILOG_WORDS = frozenset(
    """always and assign automatic begin buf bufif0 bufif1 case casex casez cell cmos config deassign default defparam design disable
    edge else end endcase endconfig endfunction endgenerate endmodule endprimitive endspecify endtable endtask event for force forever fork
    function generate genvar highz0 highz1 if ifnone incdir include initial inout input instance integer join large liblist library
    localparam macromodule medium module nand negedge nmos nor noshowcancelled not notif0 notif1 or output parameter pmos posedge primitive
    pull0 pull1 pulldown pullup pulsestyle_onevent pulsestyle_ondetect rcmos real realtime reg release repeat rnmos rpmos rtran rtranif0
    rtranif1 scalared showcancelled signed small specify specparam strong0 strong1 supply0 supply1 table task time tran tranif0 tranif1 tri
    tri0 tri1 triand trior trireg unsigned use uwire vectored wait wand weak0 weak1 while wire wor xnor xor""".split()
)
# Reserved words that SystemVerilog (1800-2017) adds.
SYSTEM_WORDS = frozenset(
    """accept_on alias always_comb always_ff always_latch assert assume before bind bins binsof bit break byte chandle checker class
    clocking const constraint context continue cover covergroup coverpoint cross dist do endchecker endclass endclocking endgroup
    endinterface endpackage endprogram endproperty endsequence enum eventually expect export extends extern final first_match foreach
    forkjoin global iff ignore_bins illegal_bins implements implies import inside int interconnect interface intersect join_any join_none
    let local logic longint matches modport nettype new nexttime null package packed priority program property protected pure rand randc
    randcase randsequence ref reject_on restrict return s_always s_eventually s_nexttime s_until s_until_with sequence shortint shortreal
    soft solve static string strong struct super sync_accept_on sync_reject_on tagged this throughout timeprecision timeunit type typedef
    union unique unique0 until until_with untyped var virtual void wait_order weak wildcard with within""".split()
)

# Classes of the operators; a token that is not here is its own class.
VERILOG_CLASSES = {
    **dict.fromkeys("/ % == != === !== >= && || <<< >>> **".split(), "BIN"),
    **dict.fromkeys("<< >>".split(), "SHIFT"),
    **dict.fromkeys("+ - & | ^ ~& ~| ~^ ^~".split(), "PM"),
    **dict.fromkeys("! ~".split(), "UN"),
    **dict.fromkeys("wire tri tri0 tri1 triand trior trireg wand wor uwire supply0 supply1".split(), "NET"),
    **dict.fromkeys("and nand or nor xor xnor buf not bufif0 bufif1 notif0 notif1 nmos pmos cmos rnmos rpmos rcmos tran tranif0 tranif1 rtran rtranif0 rtranif1 pullup pulldown".split(), "GATE"),
    **dict.fromkeys("strong0 strong1 weak0 weak1 pull0 pull1 highz0 highz1 small medium large".split(), "STRENGTH"),
    **dict.fromkeys("integer real realtime time".split(), "INTTYPE"),
    **dict.fromkeys("input output inout".split(), "DIR"),
    **dict.fromkeys("case casez casex".split(), "CASE"),
    "or": "or", "scalared": "VEC", "vectored": "VEC", "~&": "UN2", "~|": "UN2", "~^": "PM", "^~": "PM",
}
SYSTEM_CLASSES = VERILOG_CLASSES | {
    **dict.fromkeys("==? !=? <->".split(), "BIN"),
    **dict.fromkeys("+= -= *= /= %= &= |= ^= <<= >>= <<<= >>>=".split(), "OPSET"),
    **dict.fromkeys("++ --".split(), "INC"),
    **dict.fromkeys("logic bit reg".split(), "VEC2"),
    **dict.fromkeys("integer real realtime time byte shortint int longint shortreal string chandle".split(), "INTTYPE"),
    **dict.fromkeys("unique unique0 priority".split(), "UNIQUE"),
    **dict.fromkeys("always_comb always_latch always_ff".split(), "ALWAYS"),
    "signed": "SIGN", "unsigned": "SIGN",
}

_VERILOG_COMMON = r"""
expr: unary* term ((BIN | PM | SHIFT | "*" | "<=" | "<" | ">") unary* term)* ("?" attr* expr ":" expr)?
unary: UN | UN2 | PM
minmax: expr (":" expr ":" expr)?
term: NUM | STR | name callargs? | SYS sysargs? | "(" minmax ")" | "{" expr ("{" list(expr) "}" | ("," expr)*) "}"
callargs: "(" list(expr) ")"
sysargs: "(" list(expr?) ")"
name: ID select* ("." ID select*)*
select: "[" expr ((":" | "+:" | "-:") expr)? "]"
lval: name | "{" list(lval) "}"
range: "[" expr ":" expr "]"
attr: "(*" list(ID ("=" expr)?) "*)"
delay: "#" (NUM | name | "(" minmax ("," minmax)* ")")
event: "@" (name | "*" | "(*)" | "(" evitem (("or" | ",") evitem)* ")")
strength: "(" STRENGTH ("," STRENGTH)* ")"
ported: ID range? "(" ports_in? ")"
conn: attr* expr?
named: attr* "." ID "(" expr? ")"
ports_in: list(conn) | list(named)
inst: ID override? list(ported) ";"
override: "#" (NUM | name | "(" (list(expr) | list("." ID "(" minmax? ")")) ")")
gate: (GATE | "or") strength? delay? list((ID range?)? "(" list(expr) ")") ";"
assign: "assign" strength? delay? list(lval "=" expr) ";"
defparam: "defparam" list(name "=" minmax) ";"
specify: "specify" specitem* "endspecify"
specitem: "specparam" range? list(ID "=" (minmax | "(" minmax "," minmax ")")) ";" | ("pulsestyle_onevent" | "pulsestyle_ondetect" | "showcancelled" | "noshowcancelled") list(pathend) ";"
  | ("if" "(" expr ")" | "ifnone")? "(" edge? list(pathend) (PM? ("=>" | "*>") | OPSET ">") pathto ")" "=" (list(minmax) | "(" list(minmax) ")") ";" | SYS "(" list(checkarg?) ")" ";"
edge: "posedge" | "negedge" | "edge"
pathend: ID ("." ID)? ("[" minmax "]" | range | "[" expr ("+:" | "-:") expr "]")?
pathto: list(pathend) | "(" list(pathend) (PM? ":" | "+:" | "-:") expr ")"
checkarg: (edge | "edge" "[" list(NUM ID? | ID) "]")? minmax ("&&&" expr)?
udp: "primitive" ID "(" (list(ID) ")" ";" udpdecl+ | attr* DIR ("reg" | VEC2)? ID ("=" expr)? ("," attr* DIR? ID)+ ")" ";") ("initial" ID "=" expr ";")? "table" udprow+ "endtable" "endprimitive"
udpdecl: attr* (DIR ("reg" | VEC2)? list(ID) ("=" expr)? ";" | ("reg" | VEC2) ID ";")
udprow: (udplevel | "*" | "(" udplevel+ ")")+ ":" (udplevel | PM) (":" (NUM | ID | PM))? ";"
udplevel: NUM | ID | "?"
portref: ID ("[" expr (":" expr)? "]")? | "{" list(ID ("[" expr (":" expr)? "]")?) "}"
plainport: (portref | "." ID "(" portref? ")")?
"""

VERILOG = (
    _VERILOG_COMMON
    + r"""
file: (attr* (module | udp))*
evitem: ("posedge" | "negedge")? expr
module: ("module" | "macromodule") ID ("#" "(" "parameter" ptype? pset ("," ("parameter" ptype?)? pset)* ")")? ports? ";" item* "endmodule"
ptype: "signed" range? | range | INTTYPE
pset: ID "=" minmax
ports: "(" list(plainport) ")" | "(" portdecl ("," (portdecl | ID ("=" expr)?))* ")"
portdecl: attr* DIR (NET | "reg" | INTTYPE)? "signed"? range? ID ("=" expr)?
item: attr* (itembody | DIR (NET | "reg" | INTTYPE)? "signed"? range? list(ID ("=" expr)?) ";")
itembody: net | var | "event" list(ID range*) ";" | "genvar" list(ID) ";" | ("parameter" | "localparam") ptype? list(pset) ";"
  | "specparam" range? list(pset) ";" | specify | assign | defparam | gate | inst | "always" stmt | "initial" stmt | function | task
  | "generate" item* "endgenerate" | genif | genfor | gencase
net: NET strength? VEC? "signed"? range? delay? list(ID range* | ID "=" expr) ";"
var: ("reg" "signed"? range? | INTTYPE) list(ID range* | ID "=" expr) ";"
function: "function" "automatic"? ("signed"? range | "signed" | INTTYPE)? ID ("(" fport ("," (fport | ID))* ")")? ";" fdecl* stmt "endfunction"
task: "task" "automatic"? ID ("(" (fport ("," (fport | ID))*)? ")")? ";" fdecl* stmt "endtask"
fport: attr* DIR ("reg"? "signed"? range? | INTTYPE) ID
fdecl: attr* (DIR ("reg"? "signed"? range? | INTTYPE) list(ID) ";" | var | "event" list(ID range*) ";" | ("parameter" | "localparam") ptype? list(pset) ";")
genif: "if" "(" expr ")" genblock ("else" genblock)?
genfor: "for" "(" ID "=" expr ";" expr ";" ID "=" expr ")" genblock
gencase: "case" "(" expr ")" ((list(expr) ":" | "default" ":"?) genblock)+ "endcase"
genblock: item | ";" | "begin" (":" ID)? item* "end"
stmt: attr* (";" | body)
body: "begin" (":" ID fdecl*)? stmt* "end" | "fork" (":" ID fdecl*)? stmt* "join" | "if" "(" expr ")" stmt ("else" stmt)?
  | CASE "(" expr ")" ((list(expr) ":" | "default" ":"?) stmt)+ "endcase"
  | "forever" stmt | "repeat" "(" expr ")" stmt | "while" "(" expr ")" stmt | "for" "(" lval "=" expr ";" expr ";" lval "=" expr ")" stmt
  | "wait" "(" expr ")" stmt | "disable" name ";" | "->" name ";" | (delay | event) stmt
  | lval ("=" | "<=") (delay | event | "repeat" "(" expr ")" event)? expr ";"
  | name ("(" list(expr?) ")")? ";" | SYS sysargs? ";"
  | ("assign" | "force") lval "=" expr ";" | ("deassign" | "release") lval ";"
"""
)

SYSTEM_VERILOG = (
    _VERILOG_COMMON
    + r"""
file: desc*
desc: attr* (module | udp end_name | interface | package | program | class | pkgitem | bind | item)
evitem: ("posedge" | "negedge" | "edge")? expr ("iff" expr)?
event: "@" (name | "*" | "(*)" | "(" evlist ")")
evlist: evpart (("or" | ",") evpart)*
evpart: evitem | "(" evlist ")"
end_name: (":" (ID | "new"))?
module: ("module" | "macromodule") life? ID import* params? ports? ";" item* "endmodule" end_name
interface: "interface" life? ID import* params? ports? ";" (item | modport)* "endinterface" end_name
program: "program" life? ID import* params? ports? ";" item* "endprogram" end_name
package: "package" life? ID ";" (attr* pkgitem)* "endpackage" end_name
class: "virtual"? "class" life? ID params? ("extends" type_name ("(" list(expr?) ")")?)? ("implements" list(type_name))? ";" citem* "endclass" end_name
citem: attr* (quals (classvar | function | task | class | "constraint" ID (cblock | ";")) | quals ("extern" | "pure") quals proto | typedef | param ";" | ";" | covergroup)
quals: ("static" | "protected" | "local" | "rand" | "randc" | "const" | "virtual" | "pure" | "extern")*
classvar: type list(ID dim* ("=" expr)?) ";"
proto: "function" life? type? fname ("(" list(fport)? ")")? ";" | "task" life? fname ("(" list(fport)? ")")? ";"
cblock: "{" (cexpr | "solve" list(name) "before" list(name) ";")* "}"
cexpr: "soft"? exprdist ";" | expr "->" cset | UNIQUE "{" list(crange) "}" ";" | "if" "(" expr ")" cset ("else" cset)? | "foreach" "(" name ("[" list(ID?) "]")? ")" cset | "disable" "soft" name ";"
cset: cexpr | "{" cexpr* "}"
exprdist: expr ("dist" "{" list(crange (":" ("=" | BIN) expr)?) "}")?
covergroup: "covergroup" ID ("(" list(fport)? ")")? (event | "with" "function" ID "(" list(fport)? ")" | "@" "@" "(" blockevent ("or" blockevent)* ")")? ";" cgitem* "endgroup" end_name
blockevent: ("begin" | "end") name
cgitem: attr* (name "=" expr ";" | (type? ID ":")? "coverpoint" expr iff? (";" | "{" (attr* binitem? ";")* "}") | (ID ":")? "cross" list(name) iff? (";" | "{" (attr* crossitem? ";" | function)* "}") | ";")
iff: "iff" "(" expr ")"
binkind: "bins" | "illegal_bins" | "ignore_bins"
binitem: name "=" expr | "wildcard"? binkind ID ("[" expr? "]")? "=" binset iff?
binset: "{" list(crange) "}" ("with" "(" expr ")")? | expr ("with" "(" expr ")")? | list("(" binstep ("=>" binstep)* ")") | "default" "sequence"?
binstep: list(crange) rep?
crossitem: name "=" expr | binkind ID "=" selexpr iff?
selexpr: selterm (BIN selterm)* ("matches" expr)?
selterm: UN? ("binsof" "(" name ")" ("intersect" "{" list(crange) "}")? | "(" selexpr ")" | expr) ("with" "(" expr ")")?
rep: "[" ("*" | PM | "->" | "=") (expr (":" expr)?)? "]"
modport: "modport" list(ID "(" list(DIR? ID | ("import" | "export") ID) ")") ";"
life: "static" | "automatic"
import: "import" list(ID "::" (ID | "*")) ";"
bind: "bind" name inst
params: "#" "(" list(pport)? ")"
pport: (("parameter" | "localparam")? (type? pset | "type" ID ("=" type)?))
pset: ID dim* ("=" (minmax | type))?
param: ("parameter" | "localparam") (type? list(pset) | "type" list(ID ("=" type)?))
pkgitem: import | "export" ("*" "::" "*" | list(ID "::" (ID | "*")) | STR (ID "=")? ("function" | "task") ID) ";" | param ";" | typedef | function | task | data | net | class | ";" | "timeunit" NUM ("/" NUM)? ";" | "timeprecision" NUM ";"
typedef: "typedef" (type ID dim* | ("enum" | "struct" | "union" | "class")? ID | "interface" "class" ID) ";"
type: basic | type_name dim* | enum | struct | "type" "(" (expr | type) ")" | "virtual" "interface"? type_name | "event" | "void" | "interface" ("." ID)?
basic: VEC2 SIGN? dim* | INTTYPE SIGN? dim* | SIGN dim* | dim+
type_name: ID (("#" "(" (list(expr | basic) | list("." ID "(" (expr | basic)? ")"))? ")")? "::" ID)* ("." ID)?
enum: "enum" (basic | type_name dim*)? "{" list(ID ("[" expr (":" expr)? "]")? ("=" expr)?) "}" dim*
struct: ("struct" | "union" "tagged"?) ("packed" SIGN?)? "{" (attr* ("rand" | "randc")? type list(ID dim* ("=" expr)?) ";")+ "}" dim*
dim: "[" (expr (":" expr)? | "$" (":" expr)? | "*" | basic)? "]"
ports: "(" list(plainport) ")" | "(" list(portdecl) ")"
portdecl: attr* (DIR | "ref" | "const" "ref")? (NET | "var")? type? ID dim* ("=" expr)? | attr* (DIR)? "." ID "(" expr? ")"
item: attr* (itembody | (DIR | "ref") (NET | "var")? type? list(ID dim* ("=" expr)?) ";" | extern | ";")
itembody: net | data | typedef | import | class | "genvar" list(ID) ";" | param ";" | specify | "specparam" dim? list(pset) ";" | assign | defparam | gate | inst | alwaysany
  | ("initial" | "final") stmt | function | task | "generate" (item | genbegin)* "endgenerate" | genif | genfor | gencase | assertion | (ID ":") assertion
  | "alias" list(lval) ";" | property | covergroup | modport | clocking
  | "timeunit" NUM ("/" NUM)? ";" | "timeprecision" NUM ";" | let
extern: "extern" (("module" | "macromodule" | "interface" | "program") life? ID import* params? ports? ";" | "primitive" ID "(" (list(ID) | attr* DIR VEC2? ID ("=" expr)? ("," attr* DIR? ID)+) ")" ";" | "forkjoin"? proto)
clocking: ("default" | "global")? "clocking" ID? event ";" clockitem* "endclocking" end_name | "default" "clocking" name ";" | "default" "disable" "iff" exprdist ";"
clockitem: attr* ("default" clockdir ";" | clockdir list(ID ("=" expr)?) ";" | property | let)
clockdir: DIR skew? (DIR skew?)?
skew: edge delay? | delay
let: "let" ID ("(" list(attr* ("untyped" | type)? ID dim* ("=" expr)?)? ")")? "=" expr ";"
alwaysany: ("always" | ALWAYS) stmt
property: ("property" ID propports? ";" data* propexpr ";"? "endproperty" | "sequence" ID propports? ";" data* propexpr ";"? "endsequence") end_name
propports: "(" list(attr* "local"? DIR? ("property" | "sequence" | "untyped" | type)? ID dim* ("=" propexpr)?)? ")"
propexpr: propfirst* propterm (propjoin propfirst* propterm)*
propfirst: GATE | ("nexttime" | "s_nexttime" | "always" | "s_always" | "eventually" | "s_eventually") propspan? | ("accept_on" | "reject_on" | "sync_accept_on" | "sync_reject_on") "(" exprdist ")" | event | "disable" "iff" "(" exprdist ")" | steps
propjoin: "or" | GATE | "intersect" | "within" | "throughout" | PM "->" | OPSET ">" | "#" (PM | "=") "#" | "until" | "s_until" | "until_with" | "s_until_with" | "implies" | "iff" | steps
propspan: "[" expr (":" expr)? "]"
steps: "##" (NUM | name | "(" expr ")" | "[" (expr ":" expr | "*" | PM) "]")
propterm: exprdist rep? | ("(" propexpr ("," (setting | name | SYS sysargs?))* ")" | "first_match" "(" propexpr ("," (setting | name | SYS sysargs?))* ")" | ID "(" list(propexpr | "." ID "(" propexpr? ")") ")") rep? | ("strong" | "weak") "(" propexpr ")"
  | "if" "(" exprdist ")" propexpr ("else" propexpr)? | CASE "(" exprdist ")" ((list(exprdist) ":" | "default" ":"?) propexpr ";"?)+ "endcase"
assertion: ("assert" | "assume" | "cover" | "restrict") ("property" | "sequence") "(" propexpr ")" action
action: ";" | stmt ("else" stmt)? | "else" stmt
net: NET strength? (VEC? type)? delay? list(ID dim* ("=" expr)?) ";"
data: ("const" | "var" | life)* (type | "var") list(ID dim* ("=" (expr | newcall))?) ";"
newcall: "new" ("[" expr "]")? ("(" list(arg) ")")?
inst: ID override? list(ported) ";"
ported: ID dim* "(" ports_in? ")" | "(" ports_in? ")"
ports_in: list(conn) | list(anynamed)
anynamed: attr* "." (ID ("(" expr? ")")? | "*") | attr* ".*"
override: "#" (NUM | name | "(" (list(expr | basic) | list("." ID "(" (minmax | type)? ")"))? ")")
function: "function" life? (type)? fname ("(" list(fport)? ")")? ";" (fdecl | stmt)* "endfunction" end_name
task: "task" life? fname ("(" list(fport)? ")")? ";" (fdecl | stmt)* "endtask" end_name
fname: (ID ("::" | "."))* (ID | "new")
fport: attr* (DIR | "ref" | "const" "ref")? "var"? type? ID dim* ("=" expr)?
fdecl: attr* ((DIR | "ref") "var"? type? list(ID dim* ("=" expr)?) ";" | data | typedef | param ";" | import)
genif: "if" "(" expr ")" genblock ("else" genblock)?
genfor: "for" "(" "genvar"? ID "=" expr ";" expr ";" (lval ("=" | OPSET) expr | lval INC | INC lval) ")" genblock
gencase: "case" "(" expr ")" ((list(expr) ":" | "default" ":"?) genblock)+ "endcase"
genbegin: (ID ":")? "begin" (":" ID)? (item | genbegin)* "end" end_name
genblock: item | genbegin
stmt: (ID ":")? attr* (";" | body)
body: "begin" (":" ID)? (fdecl | stmt)* "end" end_name | "fork" (":" ID)? (fdecl | stmt)* ("join" | "join_any" | "join_none") end_name
  | UNIQUE? "if" "(" expr ("&&&" expr)* ")" stmt ("else" stmt)?
  | UNIQUE? CASE "(" expr ")" ("inside" | "matches")? ((list(crange) ":" | "default" ":"?) stmt)+ "endcase"
  | "forever" stmt | "repeat" "(" expr ")" stmt | "while" "(" expr ")" stmt | "do" stmt "while" "(" expr ")" ";"
  | "for" "(" list(forinit)? ";" expr? ";" list(setting)? ")" stmt
  | "foreach" "(" name ")" stmt | "wait" ("(" expr ")" stmt | "fork" ";") | "wait_order" "(" list(name) ")" action | "disable" (name | "fork") ";" | ("->" | "->>") name ";"
  | "return" expr? ";" | "break" ";" | "continue" ";" | (delay | event) stmt
  | setting ";" | lval "<=" (delay | event | "repeat" "(" expr ")" event)? expr ";" | lval "=" (delay | event | "repeat" "(" expr ")" event) expr ";"
  | lval "=" newcall ";" | "void" "'" "(" expr ")" ";" | name ";" | SYS sysargs? ";"
  | ("assign" | "force") lval "=" expr ";" | ("deassign" | "release") lval ";"
  | ("assert" | "assume" | "cover") ("#" NUM | "final")? "(" expr ")" action | assertion | "randcase" (expr ":" stmt)+ "endcase"
forinit: type ID "=" expr | ID "=" expr | "var" type? ID "=" expr | lval "=" expr
setting: lval ("=" | OPSET) expr | lval INC | INC lval
crange: expr | "[" (expr | "$") ":" (expr | "$") "]"
expr: unary* term ((BIN | PM | SHIFT | "*" | "<=" | "<" | ">" | "->") unary* term | "inside" "{" list(crange) "}")* ("?" attr* expr ":" expr)?
unary: UN | UN2 | PM | INC
term: (NUM | STR | name | SYS sysargs? | "(" (minmax | lval (OPSET | "=") expr) ")" | concat select* | pattern | "null" | "$" | "new" | stream) cast* INC?
  | "local" "::" name cast* | basic "'" castarg cast* | "void" "'" castarg | "tagged" ID expr?
cast: "'" castarg
castarg: "(" minmax ")" | "{" patlist "}"
concat: "{" (expr ("{" list(expr) "}" | ("," expr)*))? "}"
stream: "{" SHIFT (expr | basic)? "{" list(expr) "}" "}"
pattern: "'" "{" patlist "}"
patlist: list((expr | "default" | basic) (":" expr)?)? | expr "{" list(expr) "}"
name: (ID | "this" | "super") part*
sysargs: "(" list((expr | event)?) ")"
part: "." (ID | "new") | "::" ID | select | "(" list(arg)? ")" | "#" "(" list(expr | basic) ")" "::" ID | "with" ("(" list(expr)? ")")? cblock?
arg: (expr | basic)? | "." ID "(" expr? ")"
select: "[" (expr ((":" | "+:" | "-:") expr)? | "$")? "]"
lval: name | concat | pattern | stream
attr: "(*" list(ID ("=" expr)?) "*)"
delay: "#" (NUM | name | "(" minmax ("," minmax)* ")" | "1step") | "##" (NUM | ID | "(" expr ")")
"""
)

JSON = r"""
file: value
value: STR | NUM | "true" | "false" | "null" | "{" (list(STR ":" value))? "}" | "[" (list(value))? "]"
"""

# The keywords of Python 3.
PYTHON_WORDS = frozenset(
    """False None True and as assert async await break class continue def del elif else except finally for from global if import in is
    lambda nonlocal not or pass raise return try while with yield""".split()
)
# Words that are keywords only where a statement or a pattern begins.
PYTHON_SOFT_WORDS = frozenset("match case type".split())
PYTHON_CLASSES = {
    **dict.fromkeys("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split(), "OPSET"),
    **dict.fromkeys("// % << >> & ^".split(), "AR"),
    **dict.fromkeys("+ -".split(), "PM"),
    **dict.fromkeys("< > == >= <= !=".split(), "CMP"),
    **dict.fromkeys("True False None".split(), "CONST"),
}

PYTHON = r"""
file: (stmt | NEWLINE)*
field: exprs | yieldexpr
name: NAME | "match" | "case" | "type"
stmt: simples | compound
simples: simple (";" simple)* ";"? NEWLINE
simple: exprs | yieldexpr | (targets "=")+ (exprs | yieldexpr) | single OPSET (exprs | yieldexpr) | single ":" test ("=" (exprs | yieldexpr))?
  | "del" list(target) ","? | "pass" | "break" | "continue" | "return" exprs? | "raise" (test ("from" test)?)? | ("global" | "nonlocal") list(name)
  | "import" list(dotted ("as" name)?) | "from" (("." | "...")* dotted | ("." | "...")+) "import" ("*" | list(name ("as" name)?) | "(" list(name ("as" name)?) ","? ")")
  | "assert" test ("," test)? | "type" name tparams? "=" test
dotted: name ("." name)*
single: name | place | "(" single ")"
targets: starget ("," starget)* ","?
starget: "*"? target
target: name | place | "(" target ")" | "(" (starget "," targets?)? ")" | "[" targets? "]"
place: atom trailer* ("." name | "[" subs "]")
exprs: sexpr ("," sexpr)* ","?
sexpr: "*" bitor | test
stars: star ("," star)* ","?
star: "*" bitor | named
named: name ":=" test | test
yieldexpr: "yield" ("from" test | exprs)?
test: ortest ("if" ortest "else" test)? | "lambda" lparams ":" test
ortest: nottest (("or" | "and") nottest)*
nottest: "not"* compare
compare: bitor ((CMP | "in" | "not" "in" | "is" "not"?) bitor)*
bitor: factor ((AR | PM | "/" | "|" | "@" | "*" | "**") factor)*
factor: (PM | "~")* "await"? atom trailer*
atom: name | NUM | STR+ | BYTES+ | CONST | "..." | "(" (yieldexpr | named comp | named | star "," stars?)? ")" | "[" (named comp | stars)? "]"
  | "{" (pair ("," pair)* ","? | test ":" test comp | stars | named comp)? "}"
pair: "**" bitor | test ":" test
trailer: "(" args? ")" | "[" subs "]" | "." name
subs: sub ("," sub)* ","?
sub: named | test? ":" test? (":" test?)? | "*" test
comp: ("async"? "for" targets "in" ortest ("if" ortest)*)+
args: (posarg ("," posarg)* ("," kwargs)? | kwargs) ","? | named comp
posarg: named | "*" test
kwargs: list(kwstar) ("," list(kwdict))? | list(kwdict)
kwstar: name "=" test | "*" test
kwdict: name "=" test | "**" test
compound: "if" named ":" suite ("elif" named ":" suite)* ("else" ":" suite)? | "while" named ":" suite ("else" ":" suite)? | "async"? "for" targets "in" exprs ":" suite ("else" ":" suite)? | trystmt
  | "async"? "with" (list(withitem) | "(" list(withitem) ","? ")") ":" suite
  | ("@" named NEWLINE)* ("async"? "def" name tparams? "(" params ")" ("->" test)? ":" suite | "class" name tparams? ("(" args? ")")? ":" suite)
  | "match" (named | star "," stars?) ":" NEWLINE INDENT ("case" patterns ("if" named)? ":" suite)+ DEDENT
tparams: "[" list(name (":" test)? ("=" test)? | "*" name ("=" sexpr)? | "**" name ("=" test)?) ","? "]"
trystmt: "try" ":" suite (handled ("else" ":" suite)? ("finally" ":" suite)? | "finally" ":" suite)
handled: ("except" (test ("as" name)?)? ":" suite)+ | ("except" "*" test ("as" name)? ":" suite)+
withitem: test ("as" starget)?
suite: simples | NEWLINE INDENT stmt+ DEDENT
patterns: pattern | spattern "," seqpattern?
seqpattern: spattern ("," spattern)* ","?
spattern: "*" name | pattern
pattern: closed ("|" closed)* ("as" name)?
closed: fixed | dotted | dotted "(" (clsargs ","?)? ")" | "(" pattern ")" | "(" (spattern "," seqpattern?)? ")" | "[" seqpattern? "]"
  | "{" (list((fixed | name ("." name)+) ":" pattern) ("," "**" name)? ","? | "**" name ","?)? "}"
fixed: PM? NUM (PM NUM)? | STR+ | BYTES+ | CONST
clsargs: list(pattern) ("," list(name "=" pattern))? | list(name "=" pattern)
params: ((plain | given | tail) ","?)?
plain: ann ("," (plain | given | "/" ("," (plainp | givenp | tail))? | tail))?
given: ann "=" test ("," (given | "/" ("," (givenp | tail))? | tail))?
plainp: ann ("," (plainp | givenp | tail))?
givenp: ann "=" test ("," (givenp | tail))?
tail: "*" name (":" sexpr)? ("," ann ("=" test)?)* ("," "**" ann)? | "*" ("," ann ("=" test)?)+ ("," "**" ann)? | "**" ann
ann: name (":" test)?
lparams: ((lplain | lgiven | ltail) ","?)?
lplain: name ("," (lplain | lgiven | "/" ("," (lplainp | lgivenp | ltail))? | ltail))?
lgiven: name "=" test ("," (lgiven | "/" ("," (lgivenp | ltail))? | ltail))?
lplainp: name ("," (lplainp | lgivenp | ltail))?
lgivenp: name "=" test ("," (lgivenp | ltail))?
ltail: "*" name ("," name ("=" test)?)* ("," "**" name)? | "*" ("," name ("=" test)?)+ ("," "**" name)? | "**" name
"""
