"""Grammars of the languages, written for predictive parsing: what they accept is the language's
syntax up to details that need types or scopes. Operators share one loop, since precedence does
not decide validity. In brackets' cover rules (arrow parameters, patterns) the union is taken."""

from __future__ import annotations

PYTHON = """
file: line*
line: compound | '@' named NL line | NL | simple
simple: small (; small?)* NL
small: pass | break | continue | del stars | return stars? | raise (expr (from expr)?)? | global n (, n)* | nonlocal n (, n)*
    | import dotted (as n)? (, dotted (as n)?)* | from (. | ...)* dotted? import fromwhat | assert expr (, expr)? | TYPE n tparams? = expr | exprstmt
dotted: n (. n)*
fromwhat: '*' | '(' n (as n)? (, (n (as n)?)?)* ')' | n (as n)? (, n (as n)?)*
exprstmt: rhs (: expr (= rhs)? | AUG rhs | (= rhs)*)
rhs: yieldexpr | stars
yieldexpr: yield (from expr | stars)?
stars: star (, star?)*
star: '*' or | named
named: expr (:= expr)?
expr: lambda lparams : expr | or (if or else expr)?
lparams: (lparam (, lparam?)*)?
lparam: '*' n? | ** n | / | n (= expr)?
or: unary (binop unary)*
binop: BIN | '*' | ** | / | - | '+' | in | is not? | not in | and | or_ | '|' | @ | ~x
unary: (- | '+' | ~ | not | await)* power
power: atom trailer*
trailer: '(' args ')' | '[' subs ']' | . n
atom: n | num | str+ | ... | lit | '(' paren? ')' | '[' paren? ']' | '{' braces? '}'
paren: yieldexpr | pitem comp? (, pitem?)*
pitem: star (as power)?
braces: bitem comp? (, bitem?)*
bitem: ** or | '*' or | named (: expr)?
args: (arg comp? (, arg?)*)?
arg: '*' expr | ** expr | named (= expr)?
subs: sub (, sub?)*
sub: '*' expr | : expr? (: expr?)? | named (: expr? (: expr?)?)?
comp: compfor+
compfor: async? for targets in or (if or)*
targets: target (, target?)*
target: '*'? power
compound: if named : suite (elif named : suite)* (else : suite)?
    | while named : suite (else : suite)? | for targets in stars : suite (else : suite)?
    | try : suite tryrest | with withitem (, withitem?)* : suite
    | def n tparams? '(' params ')' (-> expr)? : suite | class n tparams? ('(' args ')')? : suite
    | async line | MATCH stars : NL IN caseline+ DE
caseline: CASE casepat (, casepat?)* (if named)? : suite
casepat: ('*' or | or) (as n)?
withitem: expr (as target)?
tryrest: except_+ (else : suite)? (finally : suite)? | finally : suite
except_: except '*'? (stars (as n)?)? : suite
tparams: '[' (tparam (, tparam?)*)? ']'
tparam: ('*' | **)? n (: expr)? (= expr)?
params: (param (, param?)*)?
param: '*' (n ann?)? | ** n ann? | / | n ann? (= expr)?
ann: : ('*' or | expr)
suite: NL IN line+ DE | simple
"""

JSON = """
file: value
value: str | num | lit | '{' (pair (, pair)*)? '}' | '[' (value (, value)*)? ']'
pair: str : value
"""

TOML = """
file: (entry? NL)*
entry: '[' header | key = value
header: '[' key ']' ']' | key ']'
key: word (. word)*
word: n | str | num | lit
value: str | mstr | num | lit | date | '[' NL* (value NL* (, NL* (value NL*)?)*)? ']' | '{' (pair (, pair)*)? '}'
pair: key = value
"""

YAML = """
file: doc (DOC doc)*
doc: (block | deeper)?
block: items | pairs | scalarline
items: item+
item: - after
after: NL (IN block DE)? | inlineitem
inlineitem: SUB (pairs | items) BUS | rest
pairs: pair+
pair: key keyrest
keyrest: NL (IN block DE | itemsame)? | rest
rest: prop+ (NL (IN block DE | itemsame)? | core) | core
core: (scalar | flow | alias) NL (IN scalarlines DE)? | blockscalar NL
itemsame: items
scalarlines: scalarline+
scalarline: value NL
deeper: IN block DE
value: prop* (scalar | flow | alias)?
prop: tag | anchor
scalar: plain | str
flow: '{' NL* (fentry NL* (, NL* (fentry NL*)?)*)? '}' | '[' NL* (fentry NL* (, NL* (fentry NL*)?)*)? ']'
fentry: prop* (scalar | flow | alias) (NL* : NL* (prop* (scalar | flow | alias))?)? | key
"""

_SCRIPT = """
file: stmt*
stmt: block | ; | import_ | export_ | decl | if '(' expr ')' stmt (else stmt)? | for await? '(' forhead ')' stmt
    | while '(' expr ')' stmt | do stmt while '(' expr ')' ;? | return retval SEMI | throw expr SEMI | break n? SEMI | continue n? SEMI
    | switch '(' expr ')' '{' (case expr : stmt* | default : stmt*)* '}' | try block trytail | debugger SEMI | TSSTMT | expr labelrest
labelrest: : stmt | SEMI
retval: expr?
trytail: catch ('(' bind TYPEANN ')')? block (finally block)? | finally block
block: '{' stmt* '}'
decl: function '*'? n funcrest | class_ | (var | const | let) binds SEMI | decorator+ (export_ | class_)
binds: bound (, bound)*
bound: bind !? TYPEANN (= assign)?
bind: n | '[' arr ']' | '{' members '}'
forhead: (var | const | let) bind TYPEANN (= assign)? (, bound)* (of assign | in expr | ; expr? ; expr?) | ; expr? ; expr? | expr (of assign | ; expr? ; expr?)
funcrest: TPARAMS params TYPEANN FUNCBODY
params: '(' (param (, param?)*)? ')'
param: decorator* (PARAMNAME | this | '[' arr ']' | '{' members '}' | '...' bind) '?'? TYPEANN (= assign)?
class_: class n? TPARAMS (extends operand TARGS)? IMPLEMENTS '{' (member | ;)* '}'
member: decorator* '*'? mname+ ('?' | !)? (TPARAMS params TYPEANN FUNCBODY | TYPEANN (= assign)? SEMI | block)
mname: name | str | num | PRIV | '[' expr TYPEANN ']' | '*'
name: n | KW
KW: if | else | for | while | do | return | throw | break | continue | switch | case | default | try | catch | finally | debugger | function | class | var | const | let
    | new | typeof | void | delete | await | yield | in | of | instanceof | this | super | lit | import | export | extends | async
decorator: @ operand
import_: import (str SEMI | '(' args ')' postfix* exprtail SEMI | . n postfix* exprtail SEMI | importwhat from str (with obj)? SEMI | n = expr SEMI)
obj: '{' members '}'
importwhat: n (, importmore)? | importmore | TYPEONLY
importmore: '*' as name | '{' (spec (, spec?)*)? '}'
spec: TYPEMOD (name | str) (as (name | str))?
export_: export (default exported | '*' (as name)? from str SEMI | '{' (spec (, spec?)*)? '}' (from str)? SEMI | TSEXPORT | decl | ASYNCFN)
exported: function '*'? n? funcrest | class_ | ABSTRACT class_ | TSSTMT | assign SEMI
ASYNCFN: async function '*'? n? funcrest
expr: assign (, assign)*
assign: yield '*'? assign? | operand tail
tail: (binop operand | ASTYPE)* ('?' assign : assign)? (=> arrowbody | ASSIGN assign | = assign)?
exprtail: tail (, assign)*
arrowbody: block | assign
binop: BIN | '*' | - | '+' | / | % | in | instanceof | '|' | & | < | > MORE
operand: (! | ~ | - | '+' | ++ | -- | typeof | void | delete | await)* primary postfix*
postfix: (. | ?.) (name | PRIV | '[' expr ']' | args_ | tmpl) | '[' expr ']' | args_ | tmpl | ++ | -- | BANG | CALLT
args_: '(' args ')'
args: (arg (, arg?)*)?
arg: '...' assign | assign
primary: n | num | str | tmpl | regex | this | super | lit | PRIV | paren | '[' arr ']' | '{' members '}' | function '*'? n? funcrest | class_ | new newrest
    | import ('(' args ')' | . n) | async (function '*'? n? funcrest | n | arrowparams)? | arrowparams | jsx | TSCAST
newrest: . n | operand
arrowparams: '(A' (param (, param?)*)? ')A' TYPEANN
paren: '(' (arg (, arg?)*)? ')'
arr: ,* (arg (, arg?)*)?
members: (prop (, prop?)*)?
prop: '...' assign | '*'? mname+ (params TYPEANN block | : assign | = assign)?
"""

JAVASCRIPT = (
    _SCRIPT
    + """
TSSTMT: NEVER
TSCAST: NEVER
PARAMNAME: n
TYPEANN:
TPARAMS:
TARGS:
IMPLEMENTS:
FUNCBODY: block
TYPEONLY: NEVER
TYPEMOD:
TSEXPORT: NEVER
ABSTRACT: NEVER
ASTYPE: NEVER
BANG: NEVER
CALLT: NEVER
MORE:
"""
)

TYPESCRIPT = (
    _SCRIPT
    + """
TSSTMT: INTERFACE n TPARAMS (extends type (, type)*)? objtype | TYPE n TPARAMS = type SEMI | ENUM n '{' (mname (= assign)? (, (mname (= assign)?)?)*)? '}'
    | NAMESPACE (n | str) (. n)* block | DECLARE declared | ABSTRACT class_
declared: function '*'? n TPARAMS params TYPEANN SEMI | TSSTMT | decl | block
TYPEANN: (: type)?
TSCAST: < tparam (, tparam?)* > operand
PARAMNAME: (n | READONLY)+
TPARAMS: (< tparam (, tparam?)* >)?
tparam: const? type (= type)?
TARGS: (< type (, type)* >)?
IMPLEMENTS: (IMPL type (, type)*)?
FUNCBODY: block | SEMI
TYPEONLY: NEVER
TYPEMOD: TYPEWORD?
TSEXPORT: TSSTMT | = expr SEMI | TYPEWORD '{' (spec (, spec?)*)? '}' (from str)? SEMI
ABSTRACT: ABS
ASTYPE: as type | SATISFIES type
BANG: !
CALLT: <T type (, type)* >T
MORE: (> >?)? =?
type: ('|' | &)? union (extends union '?' type : type)?
union: inter (('|' | &) inter)*
inter: (KEYOF | READONLY)* prim ('[' type? ']')* (IS type)?
prim: n (. n)* targs? | str | num | - num | tmpl | lit | this | void | typeof n (. n)* | objtype | '[' (titem (, titem?)*)? ']' | new? TPARAMS '(' (titem (, titem?)*)? ')' (=> type)?
    | < tparam (, tparam?)* > '(' (titem (, titem?)*)? ')' => type | import '(' str ')' (. n)* | new '(' (titem (, titem?)*)? ')' => type | NEVER
    | '(A' (titem (, titem?)*)? ')A' => type
targs: < type (, type)* > | <T type (, type)* >T
titem: '...'? type '?'? (: type)? | this : type
objtype: '{' (tmember)* '}'
tmember: (, | ;) | (- | '+')? tname+ ('?' | - '?')? (TPARAMS '(' (titem (, titem?)*)? ')' TYPEANN | TYPEANN) | '(' (titem (, titem?)*)? ')' TYPEANN
tname: name | str | num | '[' titem (in type (as type)?)? ']' | READONLY | KEYOF | TYPEWORD
"""
)

_GO = """
file: package n ; (importd ;)* (top ;)*
importd: import (ispec | '(' (ispec ;?)* ')')
ispec: (n | .)? str
top: func_ | decl
func_: func ('(' params ')')? n tparams? '(' params ')' result? block?
tparams: '[' params ']'
params: (param (, param?)*)?
param: '...'? type ('...'? type)?
result: '(' params ')' | type
type: n (. n)? ('[' (type (, type)*)? ']')? | '*' type | '[' (num | n | ...)? ']' type | map '[' type ']' type | chan <-? type | <- chan type
    | func '(' params ')' result? | struct '{' field? (; field?)* '}' | interface '{' imember? (; imember?)* '}' | '(' type ')' | ~ type
field: '*' n (. n)? str? | n (, n)* fieldtype? str?
fieldtype: . n | type
imember: n (. n | '(' params ')' result?)? ('|' type)* | type ('|' type)*
decl: var (vspec | '(' (vspec? ;)* ')') | const (vspec | '(' (vspec? ;)* ')') | type_ (tspec | '(' (tspec? ;)* ')')
vspec: n (, n)* vtype? (= exprs)?
vtype: type
tspec: n (= type | '[' tafter | type)
tafter: ']' type | (num | ...) ']' type | n (']' type | (, n)* type ('|' type)* (, param ('|' type)*)* ']' =? type)
block: '{' stmts '}'
stmts: stmt? (; stmt?)*
stmt: decl | if_ | for forhead block | switch (simpleN (; simpleN?)?)? '{' (case exprs : stmts | default : stmts)* '}' | select '{' (case simple : stmts | default : stmts)* '}'
    | return exprs? | go expr | defer expr | break n? | continue n? | goto n | fallthrough | block | simple (: stmt?)?
if_: if simpleN (; simpleN)? block (else (if_ | block))?
forhead: (range exprN | ; exprN? ; simpleN? | simpleN (; exprN? ; simpleN?)?)?
"""
_GO_EXPR = """
simpleX: exprsX (:= range? exprsX | = range? exprsX | ASSIGN exprsX | ++ | -- | <- exprX)?
exprsX: exprX (, exprX)*
exprX: unaryX (binop unaryX)*
unaryX: (- | '+' | ! | ^ | '*' | & | <-)* primaryX
primaryX: operandX postfixX*
operandX: n | num | str | char | '(' expr ')' | '[' (expr | ...)? ']' type LIT | map '[' type ']' type LIT | func '(' params ')' result? block | struct '{' field? (; field?)* '}' LIT | interface '{' '}' | chan type
"""
GO = (
    _GO
    + _GO_EXPR.replace("X", "")
    + "postfix: . (n | '(' (type_ | type) ')') | '[' slice ']' | '(' args ')' | '{' elems '}'\n"
    + _GO_EXPR.replace("X", "N")
    + "postfixN: . (n | '(' (type_ | type) ')') | '[' slice ']' | '(' args ')'\n"
    + """
LIT: ('{' elems '}' | '(' args ')')?
slice: expr? (: expr?)* (, type)*
args: (arg (, arg?)*)?
arg: expr '...'?
elems: (elem (, elem?)*)?
elem: evalue (: evalue)?
evalue: '{' elems '}' | expr
binop: BIN | - | '+' | '*' | & | ^ | '|' | <-
"""
)

JAVA = """
file: head* typedecl*
head: package qn ; | import static? n (. (n | '*'))* ;
qn: n (. n)*
typedecl: mods kind | ;
kind: class n tparams? (extends type)? (implements types)? (permits types)? body | interface n tparams? (extends types)? (permits types)? body
    | enum n (implements types)? '{' enums (; member*)? '}' | RECORD n tparams? '(' params ')' (implements types)? body | @ interface n body
mods: (MOD | static | final | default | annotation)*
annotation: @ qn ('(' (annarg (, annarg?)*)? ')')?
annarg: expr | annotation
enums: (enumc (, enumc?)*)?
enumc: annotation* n ('(' args ')')? body?
body: '{' member* '}'
member: ; | mods memberrest
memberrest: kind | block | tparams? type typed
typed: n declrest | '(' params ')' throws? block | block
declrest: '(' params ')' dims throws? (block | ; | default expr ;) | dims (= init)? (, n dims (= init)?)* ;
throws: throws_ types
params: (param (, param)*)?
param: mods type '...'? (n | this) dims
types: type (, type)*
tparams: <T tparam (, tparam)* >T
tparam: n (extends type (& type)*)?
type: (n | prim) targs? (. n targs?)* dims
targs: <T (targ (, targ)*)? >T
targ: '?' ((extends | super) type)? | type
dims: ('[' ']')*
init: '{' (init (, init?)*)? '}' | expr
block: '{' stmt* '}'
stmt: block | ; | if '(' expr ')' stmt (else stmt)? | for '(' forhead ')' stmt | while '(' expr ')' stmt | do stmt while '(' expr ')' ; | try ('(' resource (; resource?)* ')')? block (catch '(' mods type ('|' type)* n ')' block)* (finally block)?
    | switch_ | return expr? ; | throw expr ; | break n? ; | continue n? ; | synchronized '(' expr ')' block | assert expr (: expr)? ; | yieldx expr ; | (class | interface | enum | RECORD) n tparams? (extends type)? (implements types)? body
    | (final | annotation | MOD)+ (kind | type n dims (= init)? (, n dims (= init)?)* ;) | expr stmtrest
stmtrest: n dims (= init)? (, n dims (= init)?)* ; | : stmt | ;
resource: (final | annotation)* expr (n = expr)?
switch_: switch '(' expr ')' '{' (case caselabel (, caselabel)* (: stmt* | -> arm) | default (: stmt* | -> arm))* '}'
caselabel: ternary n? (n ternary)? | default
arm: block | throw expr ; | expr ;
forhead: ; expr? ; exprs? | (final | annotation)* expr forrest
forrest: n dims (: expr | (= init)? (, n dims (= init)?)* ; expr? ; exprs?) | (, expr)* ; expr? ; exprs?
exprs: expr (, expr)*
args: (expr (, expr)*)?
expr: ternary (-> lambda | ASSIGN expr | = expr)?
lambda: block | expr
ternary: unary (binop unary | instanceof final? unary n?)* ('?' expr : expr)?
binop: BIN | - | '+' | '*' | & | '|' | < | > (> >?)? =?
unary: (- | '+' | ! | ~ | ++ | --)* primary postfix*
primary: n | prim | num | str | char | lit | this | super | '(' plist ')' cast? | new (annotation)* newtype newrest | switch_
cast: castable postfix*
castable: n | num | str | char | lit | this | super | new newtype newrest | '(' plist ')' cast? | ! unary | ~ unary
plist: (final? expr pmore (, final? expr pmore)*)?
pmore: (& expr)* n? dims
newtype: (n | prim) targs? (. n targs?)*
newrest: '(' args ')' body? | ('[' expr? ']')+ ('{' (init (, init?)*)? '}')?
postfix: . (targs? n | new newtype newrest | class | this | super) | '[' expr? ']' | '(' args ')' | ++ | -- | :: (n | new) | targs
"""
