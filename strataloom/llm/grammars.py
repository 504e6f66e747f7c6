"""Grammars of Python, Go, JavaScript, TypeScript and JSON for ``derivatives``.

They are somewhat wider than the languages where only names, types or the kind
of an expression decide (say, what may be assigned to); rules that need a
newline or an indent are met by the token streams of ``syntax``.
"""

from __future__ import annotations

JSON = """
value = STRING | NUMBER | 'true' | 'false' | 'null' | '{' [ pair { ',' pair } ] '}' | '[' [ value { ',' value } ] ']' ;
pair = STRING ':' value ;
"""

PYTHON = """
file = { NEWLINE | stmt } ;
stmt = line | compound ;
line = small { ';' small } [ ';' ] NEWLINE ;
block = line | NEWLINE INDENT stmt { stmt } DEDENT ;
small = { targets '=' } ( tests | yielding ) | target_one ( AUGMENT ) ( tests | yielding ) | target_one ':' test [ '=' ( tests | yielding ) ]
  | 'pass' | 'break' | 'continue' | 'return' [ tests ] | 'del' targets | 'raise' [ test [ 'from' test ] ]
  | ( 'global' | 'nonlocal' ) name { ',' name } | 'assert' test [ ',' test ]
  | 'import' dotted_as { ',' dotted_as } | 'from' ( { '.' | '...' } dotted | ( '.' | '...' ) { '.' | '...' } ) 'import' imported
  | 'type' name [ typeparams ] '=' test ;
imported = '*' | name_as { ',' name_as } | '(' name_as { ',' name_as } [ ',' ] ')' ;
name_as = name [ 'as' name ] ;
dotted = name { '.' name } ;
dotted_as = dotted [ 'as' name ] ;
compound = { '@' named NEWLINE } ( def | class ) | [ 'async' ] ( for | with ) | if | while | try | match ;
def = [ 'async' ] 'def' name [ typeparams ] '(' [ params ] ')' [ '->' tests ] ':' block ;
params = param { ',' param } [ ',' ] ;
param = [ '*' | '**' ] name [ ':' ( test | '*' or ) ] [ '=' test ] | '*' | '/' ;
typeparams = '[' typeparam { ',' typeparam } [ ',' ] ']' ;
typeparam = [ '*' | '**' ] name [ ':' test ] [ '=' test ] ;
class = 'class' name [ typeparams ] [ '(' [ args ] ')' ] ':' block ;
if = 'if' named ':' block { 'elif' named ':' block } [ 'else' ':' block ] ;
while = 'while' named ':' block [ 'else' ':' block ] ;
for = 'for' targets 'in' tests ':' block [ 'else' ':' block ] ;
with = 'with' ( with_item { ',' with_item } | '(' with_item { ',' with_item } [ ',' ] ')' ) ':' block ;
with_item = test [ 'as' target_one ] ;
try = 'try' ':' block ( except { except } [ 'else' ':' block ] [ 'finally' ':' block ] | 'finally' ':' block ) ;
except = 'except' [ [ '*' ] test { ',' test } [ 'as' name ] ] ':' block ;
match = 'match' tests ':' NEWLINE INDENT case { case } DEDENT ;
case = 'case' patterns [ 'if' named ] ':' block ;
patterns = pattern { ',' pattern } [ ',' ] ;
pattern = pattern_or [ 'as' name ] | '*' name ;
pattern_or = pattern_atom { '|' pattern_atom } ;
pattern_atom = [ '-' ] NUMBER [ ( '+' | '-' ) NUMBER ] | STRING { STRING } | CONST | dotted [ '(' [ pattern_arg { ',' pattern_arg } [ ',' ] ] ')' ]
  | '(' [ patterns ] ')' | '[' [ patterns ] ']' | '{' [ pattern_pair { ',' pattern_pair } [ ',' ] ] '}' ;
pattern_arg = [ name '=' ] pattern ;
pattern_pair = pattern_atom ':' pattern | '**' name ;
targets = target { ',' target } [ ',' ] ;
target = [ '*' ] target_one ;
target_one = name | '(' [ targets ] ')' | '[' [ targets ] ']' | atom { trailer } ( '.' name | '[' subscripts ']' ) ;
tests = tests_one { ',' tests_one } [ ',' ] ;
tests_one = named | '*' or ;
named = test [ ':=' test ] ;
yielding = 'yield' [ tests | 'from' test ] ;
test = or [ 'if' or 'else' test ] | 'lambda' [ lambda_params ] ':' test ;
lambda_params = lambda_param { ',' lambda_param } [ ',' ] ;
lambda_param = [ '*' | '**' ] name [ '=' test ] | '*' | '/' ;
or = operand { binary operand } ;
binary = BINARY | '*' | '**' | '-' | '+' | '@' | '|' | '/' | 'in' | 'not' 'in' | 'is' [ 'not' ] | 'and' | 'or' ;
operand = { '-' | '+' | '~' | 'not' | 'await' } primary ;
primary = atom { trailer } ;
trailer = '.' name | '(' [ args ] ')' | '[' subscripts ']' ;
atom = name | NUMBER | STRING { STRING } | CONST | '...' | '(' [ yielding | tests_one comp | tests ] ')' | '[' [ tests_one comp | tests ] ']'
  | '{' [ dict | tests_one comp | tests ] '}' ;
dict = pair ( comp | { ',' pair } [ ',' ] ) ;
pair = test ':' test | '**' or ;
comp = [ 'async' ] 'for' targets 'in' or { 'if' comp_if } [ comp ] ;
comp_if = or [ ':=' or ] | 'lambda' [ lambda_params ] ':' test ;
args = arg { ',' arg } [ ',' ] ;
arg = named [ comp ] | name '=' test | ( '*' | '**' ) test ;
subscripts = subscript { ',' subscript } [ ',' ] ;
subscript = tests_one | [ test ] ':' [ test ] [ ':' [ test ] ] ;
name = NAME | 'match' | 'case' | 'type' ;
"""

GO = """
file = { ';' } 'package' NAME ';' { 'import' ( import | '(' [ import { ';' import } [ ';' ] ] ')' ) ';' } { top ';' } ;
import = [ NAME | '.' ] STRING ;
top = decl | 'func' [ '(' [ params ] ')' ] NAME [ typeparams ] signature [ block ] ;
decl = 'const' ( const | '(' [ const { ';' const } [ ';' ] ] ')' ) | 'var' ( var | '(' [ var { ';' var } [ ';' ] ] ')' ) | 'type' ( typedef | '(' [ typedef { ';' typedef } [ ';' ] ] ')' ) ;
const = names [ [ type ] '=' exprs ] ;
var = names ( type [ '=' exprs ] | '=' exprs ) ;
typedef = NAME [ typeparams ] [ '=' ] type ;
names = NAME { ',' NAME } ;
typeparams = '[' typeparam { ',' typeparam } [ ',' ] ']' ;
typeparam = names union ;
union = [ '~' ] type { '|' [ '~' ] type } ;
signature = '(' [ params ] ')' [ type | '(' [ params ] ')' ] ;
params = param { ',' param } [ ',' ] ;
param = type | NAME [ '...' ] type | '...' type ;
typename = NAME [ '.' NAME ] [ '[' type { ',' type } [ ',' ] ']' ] ;
type = typename | literal_type | '*' type | 'func' signature | 'interface' '{' [ ielem { ';' ielem } [ ';' ] ] '}' | 'chan' [ '<-' ] type | '<-' 'chan' type | '(' type ')' ;
literal_type = '[' [ expr | '...' ] ']' type | 'struct' '{' [ field { ';' field } [ ';' ] ] '}' | 'map' '[' type ']' type ;
field = ( names type | [ '*' ] typename ) [ STRING ] ;
ielem = NAME signature | union ;
block = '{' stmts '}' ;
stmts = { [ stmt ] ';' } [ stmt ] ;
stmt = decl | NAME ':' [ stmt ] | simple | ( 'go' | 'defer' ) expr | 'return' [ exprs ] | ( 'break' | 'continue' ) [ NAME ] | 'goto' NAME | 'fallthrough' | block | if | switch | select | for ;
simple = exprs [ ( '=' | ':=' | ASSIGN ) exprs | '++' | '--' | '<-' expr ] ;
if = 'if' [ [ simple ] ';' ] expr block [ 'else' ( if | block ) ] ;
switch = 'switch' [ [ simple ] ';' ] [ simple ] '{' { ( 'case' expr_or_type { ',' expr_or_type } | 'default' ) ':' stmts } '}' ;
select = 'select' '{' { ( 'case' simple | 'default' ) ':' stmts } '}' ;
for = 'for' [ expr | [ simple ] ';' [ expr ] ';' [ simple ] | [ exprs ( '=' | ':=' ) ] 'range' expr ] block ;
exprs = expr { ',' expr } ;
expr = unary { ( BINARY | '-' | '+' | '*' | '&' | '^' | '|' ) unary } ;
unary = { '-' | '+' | '!' | '^' | '*' | '&' | '<-' | '~' } primary ;
primary = operand { '.' ( NAME | '(' ( type | 'type' ) ')' ) | '[' index ']' | '(' [ expr_or_type { ',' expr_or_type } [ '...' ] [ ',' ] ] ')' } ;
index = expr_or_type { ',' expr_or_type } [ ',' ] | [ expr ] ':' [ expr ] [ ':' expr ] ;
operand = NAME | NUMBER | STRING | RUNE | '(' expr_or_type ')' | 'func' signature block | typename literal | literal_type ( literal | '(' expr [ ',' ] ')' )
  | ( 'chan' [ '<-' ] type | 'interface' '{' '}' ) '(' expr [ ',' ] ')' ;
expr_or_type = expr | type ;
literal = '{' [ element { ',' element } [ ',' ] ] '}' ;
element = [ ( expr | literal ) ':' ] ( expr | literal ) ;
"""

#: Statements; ``@`` stands for '' at the top and for 'r' in functions, where one may return.
_ECMA_STATEMENTS = """
stmt@ = block@ | vars semi | exprx semi | ';' | if@ | 'do' stmt@ 'while' '(' expr ')' [ semi ] | 'while' '(' expr ')' stmt@ | for@
  | ( 'continue' | 'break' ) [ ident ] semi | 'throw' expr semi | 'with' '(' expr ')' stmt@ | switch@ | try@ | 'debugger' semi | ident ':' stmt@ | func | class | RETURN@ DECLARED ;
block@ = '{' { stmt@ } '}' ;
if@ = 'if' '(' expr ')' stmt@ [ 'else' stmt@ ] ;
for@ = 'for' [ 'await' ] '(' ( [ forvars | expr ] ';' [ expr ] ';' [ expr ] | ( ( 'var' | 'let' | 'const' ) binding | unary ) ( 'in' expr | 'of' assign ) ) ')' stmt@ ;
switch@ = 'switch' '(' expr ')' '{' { ( 'case' expr | 'default' ) ':' { stmt@ } } '}' ;
try@ = 'try' block@ ( 'catch' [ '(' binding ANNOTATION ')' ] block@ [ 'finally' block@ ] | 'finally' block@ ) ;
"""

_ECMA = """
program = { stmt | import | export } ;
semi = ';' | ASI ;
vars = ( 'var' | 'let' ) declared { ',' declared } | 'const' constant { ',' constant } ;
forvars = ( 'var' | 'let' ) declared { ',' declared } | 'const' constant { ',' constant } ;
declared = ident DEFINITE ANNOTATION [ '=' assign ] | pattern ANNOTATION '=' assign ;
constant = binding ( CONSTANT '=' assign ) ;
binding = ident | pattern ;
pattern = '{' [ bound { ',' bound } [ ',' ] ] '}' | '[' [ bound_item ] { ',' [ bound_item ] } ']' ;
bound = propname ':' binding [ '=' assign ] | ident [ '=' assign ] | '...' binding ;
bound_item = [ '...' ] binding [ '=' assign ] ;
params = param { ',' param } [ ',' ] ;
param = DECORATORS [ '...' ] PARAM [ '=' assign ] ;
func = [ 'async' ] 'function' [ '*' ] ident GENERIC '(' [ params ] ')' RESULT body ;
body = '{' { stmtr } '}' ;
class = DECORATORS ABSTRACT 'class' [ ident ] GENERIC [ 'extends' unary_base TYPEARGS ] IMPLEMENTS '{' { member | ';' } '}' ;
unary_base = primary { postfix } ;
member = DECORATORS MODIFIERS ( method | propname OPTIONAL ANNOTATION [ '=' assign ] semi ) | 'static' body MEMBERS ;
method = [ 'async' ] [ '*' ] propname OPTIONAL GENERIC '(' [ params ] ')' RESULT METHODBODY | ( 'get' | 'set' ) propname '(' [ params ] ')' RESULT METHODBODY ;
propname = ident | RESERVED | reserved | STRING | NUMBER | PRIVATE | '[' assign ']' ;
import = 'import' IMPORTTYPE ( STRING | [ ident [ ',' ] ] [ '*' 'as' ident | '{' [ specifier { ',' specifier } [ ',' ] ] '}' ] 'from' STRING ) [ 'with' object ] semi IMPORTEQUALS ;
specifier = IMPORTTYPE ( propname [ 'as' propname ] ) ;
export = 'export' ( vars semi | func | class | 'default' ( func0 | class | assignd semi DEFAULTED ) | IMPORTTYPE '{' [ specifier { ',' specifier } [ ',' ] ] '}' [ 'from' STRING ] semi | IMPORTTYPE '*' [ 'as' propname ] 'from' STRING semi EXPORTED ) ;
func0 = [ 'async' ] 'function' [ '*' ] [ ident ] GENERIC '(' [ params ] ')' RESULT body ;
expr = assign { ',' assign } ;
exprx = assignx { ',' assign } ;
assign = arrow | unary { tail } ;
assignx = arrow | unaryx { tail } ;
assigno = arrow | unaryo { tail } ;
assignd = arrow | ( prefix { prefix } primary | primaryx | object ) { postfix } { tail } ;
tail = binary unary | '?' assign ':' assign | ( '=' | ASSIGN ) assign ASTYPE ;
binary = BINARY | '-' | '+' | '*' | '<' | GREATER | 'in' | 'instanceof' ;
unary = prefix { prefix } primary { postfix } | primary { postfix } ;
unaryx = prefix { prefix } primary { postfix } | primaryx { postfix } ;
unaryo = prefix { prefix } primary { postfix } | ( primaryx | funcexpr | class ) { postfix } ;
prefix = '-' | '+' | '!' | '~' | 'typeof' | 'void' | 'delete' | 'await' | 'new' | '++' | '--' | 'yield' [ '*' ] ASSERTED ;
primary = primaryx | object | funcexpr | class ;
primaryx = ident | NUMBER | STRING | TEMPLATE | REGEX | CONST | 'this' | 'super' | 'yield' | 'new' '.' ident | 'import' ( '(' args ')' | '.' ident ) | PRIVATE | array | '(' expr ')' ;
funcexpr = func0 ;
array = '[' [ item ] { ',' [ item ] } ']' ;
item = [ '...' ] assign ;
object = '{' [ prop { ',' prop } [ ',' ] ] '}' ;
prop = propname ':' assign | ident [ '=' assign ] | '...' assign | method ;
postfix = ( '.' | '?.' ) propident | '?.' ( '[' expr ']' | '(' [ args ] ')' | TEMPLATE ) | '[' expr ']' | TYPEARGS '(' [ args ] ')' | TYPEARGS TEMPLATE | '++' | '--' NONNULL ;
propident = ident | RESERVED | reserved | PRIVATE ;
args = item { ',' item } [ ',' ] ;
arrow = [ 'async' ] ( ident | GENERIC '(' [ params ] ')' RESULT ) '=>' ( assigno | body ) ;
reserved = 'var' | 'const' | 'do' | 'while' | 'for' | 'continue' | 'break' | 'throw' | 'with' | 'if' | 'else' | 'switch' | 'case' | 'default' | 'try' | 'catch' | 'finally' | 'debugger' | 'function' | 'class' | 'extends'
  | 'import' | 'export' | 'in' | 'instanceof' | 'typeof' | 'void' | 'delete' | 'new' | 'this' | 'super' | 'return' | 'yield' | 'await' | CONST ;
"""

# What the places in capitals above are; JavaScript leaves most empty.
_JS_ONLY = {
    "RETURN@ DECLARED": "RETURN@",
    "DEFINITE": "", "CONSTANT": "", "ANNOTATION": "", "DECORATORS": "", "PARAM": "binding", "GENERIC": "", "RESULT": "", "ABSTRACT": "", "TYPEARGS": "", "IMPLEMENTS": "", "MODIFIERS": "[ 'static' ]", "OPTIONAL": "", "METHODBODY": "body", "MEMBERS": "",
    "IMPORTTYPE": "", "IMPORTEQUALS": "", "DEFAULTED": "", "EXPORTED": "", "ASTYPE": "", "ASSERTED": "", "NONNULL": "", "GREATER": "'>'",
}
_TS_ONLY = {
    "RETURN@ DECLARED": "RETURN@ | decl | [ 'await' ] 'using' constant semi",
    "DEFINITE": "[ '!' ]", "CONSTANT": "':' type | [ ':' type ]", "ANNOTATION": "[ ':' type ]", "DECORATORS": "{ '@' unary_base }", "PARAM": "{ 'public' | 'private' | 'protected' | 'readonly' | 'override' } ( binding | 'this' ) [ '?' ] [ ':' type ]", "GENERIC": "[ typeparams ]", "RESULT": "[ ':' result ]",
    "ABSTRACT": "[ 'abstract' ]", "TYPEARGS": "[ typeargs ]", "IMPLEMENTS": "[ 'implements' type { ',' type } ]",
    "MODIFIERS": "{ 'static' | 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'abstract' | 'declare' | 'accessor' }", "OPTIONAL": "[ '?' | '!' ]", "METHODBODY": "( body | semi )", "MEMBERS": "| { 'static' | 'readonly' } indexer semi",
    "IMPORTTYPE": "[ 'type' ]", "IMPORTEQUALS": "| 'import' [ 'type' ] ident '=' ( 'require' '(' STRING ')' | entity ) semi", "DEFAULTED": "| decl", "EXPORTED": "| decl | '=' expr semi | 'as' 'namespace' ident semi | 'import' ident '=' ( 'require' '(' STRING ')' | entity ) semi",
    "ASTYPE": "| ( 'as' | 'satisfies' ) ( type | 'const' )", "ASSERTED": "| '<' type '>'", "NONNULL": "| '!' | typeargs", "GREATER": "'>' [ '>' [ '>' ] ]",
}

_TS_TYPES = """
decl = interface | 'type' ident GENERIC '=' type semi | [ 'const' ] 'enum' ident '{' [ enumerator { ',' enumerator } [ ',' ] ] '}' | ( 'namespace' | 'module' ) ( entity | STRING ) nested | 'global' nested
  | 'declare' ( vars0 semi | signature | func | class | decl | 'module' STRING semi ) | signature ;
vars0 = ( 'var' | 'let' | 'const' ) ambient { ',' ambient } ;
ambient = binding ANNOTATION [ '=' assign ] ;
signature = [ 'async' ] 'function' [ '*' ] [ ident ] GENERIC '(' [ params ] ')' RESULT semi ;
nested = '{' { stmt | import | export } '}' ;
enumerator = propname [ '=' assign ] ;
interface = 'interface' ident GENERIC [ 'extends' type { ',' type } ] objecttype ;
objecttype = '{' [ typemember { ( ';' | ',' | ASI ) typemember } [ ';' | ',' | ASI ] ] '}' ;
typemember = { 'readonly' | 'static' } ( propname [ '?' ] [ ':' type ] | indexer | mapped ) | [ 'get' | 'set' ] propname [ '?' ] GENERIC '(' [ params ] ')' RESULT | [ 'new' ] GENERIC '(' [ params ] ')' RESULT ;
indexer = '[' ident ':' type ']' [ '?' ] ':' type ;
mapped = [ '+' | '-' ] [ 'readonly' ] '[' ident 'in' type [ 'as' type ] ']' [ [ '+' | '-' ] '?' ] [ ':' type ] ;
typeparams = '<' typeparam { ',' typeparam } [ ',' ] '>' ;
typeparam = { 'const' | 'in' | 'out' } ident [ 'extends' type ] [ '=' type ] ;
typeargs = '<' type { ',' type } [ ',' ] '>' ;
result = type | [ 'asserts' ] ( ident | 'this' ) 'is' type | 'asserts' ( ident | 'this' ) ;
type = functype | union [ 'extends' type '?' type ':' type ] ;
functype = [ 'abstract' ] [ 'new' ] GENERIC '(' [ params ] ')' '=>' result ;
union = [ '|' | '&' ] unit { ( '|' | '&' ) unit } ;
unit = { 'keyof' | 'unique' | 'readonly' | 'infer' } typeatom { '[' [ type ] ']' } ;
typeatom = entity TYPEARGS | 'typeof' ( entity | 'this' { '.' propident } | 'import' '(' STRING ')' { '.' propident } ) TYPEARGS | STRING | [ '-' ] NUMBER | TEMPLATE | CONST | 'this' | 'void' | objecttype | '[' [ tupleitem { ',' tupleitem } [ ',' ] ] ']' | '(' type ')'
  | 'import' '(' STRING [ ',' object ] ')' { '.' propident } TYPEARGS ;
tupleitem = [ '...' ] [ ( ident | RESERVED ) [ '?' ] ':' ] type [ '?' ] ;
entity = ident { '.' propident } ;
"""

_JS_CONTEXTUAL = ("async", "of", "get", "set", "static", "as", "from", "let")
_TS_CONTEXTUAL = (*_JS_CONTEXTUAL, "type", "interface", "enum", "namespace", "module", "global", "declare", "abstract", "implements", "public", "private", "protected", "readonly", "override", "accessor", "require", "keyof", "unique", "infer", "is", "asserts", "satisfies", "out", "using")


def _ecma(places: dict[str, str], contextual: tuple[str, ...], more: str) -> str:
    text = _ECMA + more
    for level, returns in (("", None), ("r", "'return' [ expr ] semi")):
        part = _ECMA_STATEMENTS
        key = "RETURN@ DECLARED"
        part = part.replace(key, places[key])
        part = part.replace("| RETURN@", f"| {returns}" if returns else "")
        text += part.replace("@", level)
    for place in sorted(places, key=len, reverse=True):
        if place.isupper() and "@" not in place:
            for _ in range(2):
                text = _whole(text, place, places[place])
    return text + "ident = NAME | " + " | ".join(f"'{w}'" for w in contextual) + " ;\n"


def _whole(text: str, word: str, by: str) -> str:
    return " ".join(by if w == word else w for w in text.replace("\n", " \n ").split(" "))


JAVASCRIPT = _ecma(_JS_ONLY, _JS_CONTEXTUAL, "")
TYPESCRIPT = _ecma(_TS_ONLY, _TS_CONTEXTUAL, _TS_TYPES)
