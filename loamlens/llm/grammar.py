"""Grammars of six languages, and which tokens may stand next to each other in them."""

from __future__ import annotations

import re
from functools import cache

# Each grammar is a list of rules in the usual notation: 'text' is a token, capitals are classes of tokens (NAME, NUM, STR),
# ? * + and | as in regular expressions. ^ and $ are the ends of a file. Semicolons that a language leaves out at the end of
# a line are put in by the lexer; in Python a line end is ';', and '{' and '}' of blocks are INDENT and DEDENT.

_EXPRESSION_JS = """
expr: assign (',' assign)*
assign: unary (binop unary)* ('?' assign ':' assign)? | arrow | 'yield' '*'? assign?
arrow: 'async'? (NAME | params) '=>' (assign | block)
binop: '+'|'-'|'*'|'/'|'%'|'**'|'=='|'!='|'==='|'!=='|'<'|'>'|'<='|'>='|'<<'|'>>'|'>>>'|'&'|'|'|'^^'|'&&'|'||'|'??'|'in'|'instanceof'|'='|'+='|'-='|'*='|'/='|'%='|'**='|'<<='|'>>='|'>>>='|'&='|'|='|'^='|'&&='|'||='|'??='
unary: ('!'|'-'|'+'|'~'|'typeof'|'void'|'delete'|'await'|'++'|'--'|'new')* postfix ('++'|'--')?
postfix: primary (('.'|'?.') (NAME|WORD|PRIVATE) | '[' expr ']' | '?.' '[' expr ']' | '?.'? '(' args? ')' | TPL)*
primary: NAME | NUM | STR | TPL | PRIVATE | 'this' | 'super' | 'null' | 'true' | 'false' | 'new' '.' NAME | 'import' ('.' NAME | '(' expr ')') | '(' expr? ')' | '[' (','* args? ) ']' | object | func | class | REGEX
args: ('...'? assign) (',' ('...'? assign)?)*
object: '{' (member (',' member)* ','?)? '}'
member: '...' assign | key ':' assign | NAME ('=' assign)? | ('async'|'get'|'set'|'*')* key params block
key: NAME | WORD | STR | NUM | PRIVATE | '[' assign ']'
func: 'async'? 'function' '*'? NAME? params block
block: '{' stmt* tail? '}'
tail: simple | ('if' '(' expr ')' | 'else' | 'while' '(' expr ')' | NAME ':' | 'for' '(' (('var'|'let'|'const') binds | expr)? ';' expr? ';' expr? ')' | 'for' '(' ('var'|'let'|'const')? postfix ('of'|'in') expr ')') tail
simple: expr | jump | ('var'|'let'|'const') binds | 'do' stmt 'while' '(' expr ')' | 'import' STR | 'import' imports 'from' STR | 'export' '*' ('as' NAME)? 'from' STR | 'export' names ('from' STR)? | 'export' 'default' assign | 'export' ('var'|'let'|'const') binds | 'debugger'
jump: 'return' expr? | 'throw' expr | 'break' NAME? | 'continue' NAME?
binds: bind (',' bind)*
"""

JAVASCRIPT = """
file: '^' stmt* tail? '$'
""" + _EXPRESSION_JS + """
stmt: ';' | simple ';' | block | func | class | 'export' 'default'? (func | class) | 'if' '(' expr ')' body ('else' body)? | 'for' 'await'? '(' (expr | ('var'|'let'|'const') binds)? ';' expr? ';' expr? ')' body | 'for' 'await'? '(' (('var'|'let'|'const') target | postfix) ('of'|'in') expr ')' body | 'while' '(' expr ')' body | 'do' body 'while' '(' expr ')' ';'? | 'try' block ('catch' ('(' target ')')? block)? ('finally' block)? | 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' stmt*)* ('case' expr ':' | 'default' ':')? tail? '}' | NAME ':' stmt
body: stmt
bind: target ('=' assign)?
target: NAME | '[' ','* (target ('=' assign)? (',' (target ('=' assign)?)?)*)? ','? ('...' target)? ']' | '{' ((key (':' target)? ('=' assign)? | '...' NAME) (',' (key (':' target)? ('=' assign)? | '...' NAME))* ','?)? '}'
params: '(' ((param (',' param)*) ','?)? ')'
param: '...'? target ('=' assign)?
class: 'class' NAME? ('extends' postfix)? '{' classitem* '}'
classitem: ';' | 'static' block | ('static'|'async'|'get'|'set'|'*')* key params block | 'static'? key ('=' assign)? ';' | 'static'? key ('=' assign)? '}'
imports: NAME (',' (names | '*' 'as' NAME))? | names | '*' 'as' NAME
names: '{' ((NAME|WORD|STR) ('as' (NAME|WORD|STR))? (',' (NAME|WORD|STR) ('as' (NAME|WORD|STR))?)* ','?)? '}'
"""

TYPESCRIPT = """
file: '^' stmt* tail? '$'
""" + _EXPRESSION_JS.replace("arrow: 'async'? (NAME | params) '=>'", "arrow: 'async'? typeparams? (NAME | params returns?) '=>'").replace("NAME? params block", "NAME? typeparams? params returns? block").replace("key params block", "key '?'? typeparams? params returns? block").replace("'import' imports 'from' STR |", "'import' 'type'? imports 'from' STR | 'import' NAME '=' postfix |").replace("'debugger'", "'debugger' | ('export'|'declare')* 'type' NAME typeparams? '=' type | sig").replace("('++'|'--')?\n", "('++'|'--'|'!')? (('as'|'satisfies') type)*\n").replace("| TPL)*", "| TPL | '!' | typeargs)*").replace("'new')* postfix", "'new'|typeargs)* postfix") + """
sig: ('export'|'declare'|'default'|'async')* 'function' NAME? typeparams? params returns?
stmt: ';' | simple ';' | block | func | class | ('export'|'declare'|'default'|'abstract')* (func | class | interface | enum | module) | decorator | 'if' '(' expr ')' body ('else' body)? | 'for' 'await'? '(' (expr | ('var'|'let'|'const') binds)? ';' expr? ';' expr? ')' body | 'for' 'await'? '(' (('var'|'let'|'const') target | postfix) ('of'|'in') expr ')' body | 'while' '(' expr ')' body | 'do' body 'while' '(' expr ')' ';'? | 'try' block ('catch' ('(' target (':' type)? ')')? block)? ('finally' block)? | 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' stmt*)* ('case' expr ':' | 'default' ':')? tail? '}' | NAME ':' stmt
body: stmt
bind: target '!'? (':' type)? ('=' assign)?
target: NAME | '[' ','* (target ('=' assign)? (',' (target ('=' assign)?)?)*)? ','? ('...' target)? ']' | '{' ((key (':' target)? ('=' assign)? | '...' NAME) (',' (key (':' target)? ('=' assign)? | '...' NAME))* ','?)? '}'
params: '(' ((param (',' param)*) ','?)? ')'
param: argdeco* ('public'|'private'|'protected'|'readonly'|'override')* '...'? (target|'this') '?'? (':' type)? ('=' assign)?
returns: ':' type | ':' 'asserts'? (NAME|'this') 'is' type
typeparams: '<' 'const'? NAME ('extends' type)? ('=' type)? (',' NAME ('extends' type)? ('=' type)?)* ','? '>'
typeargs: '<' type (',' type)* ('>'|'>>'|'>>>')
type: '|'? '&'? typeunit (('|'|'&') typeunit | 'extends' type '?' type ':' type)*
typeunit: ('keyof'|'readonly'|'unique'|'infer'|'typeof'|'new')* (NAME ('.' NAME)* typeargs? | 'void' | 'null' | 'true' | 'false' | 'this' | STR | TPL | '-'? NUM | '(' type ')' | typeparams? params '=>' type | '[' (('...'? (NAME '?'? ':')? type '?'?) (',' '...'? (NAME '?'? ':')? type '?'?)* ','?)? ']' | '{' typemember* typelast? '}' | 'import' '(' STR ')') ('[' type? ']')*
typemember: typelast (';'|',')
typelast: ('readonly'|'-'|'+'|'get'|'set'|'new'|'static')* (key '?'? (':' type)? | key? '?'? typeparams? params returns? | '[' NAME (':'|'in') type ('as' type)? ']' ('-'|'+')? '?'? ':' type)
class: 'class' NAME? typeparams? ('extends' postfix typeargs?)? ('implements' type (',' type)*)? '{' classitem* '}'
classitem: ';' | decorator | 'static' block | mods key '?'? typeparams? params returns? (block | ';' | '}') | mods key ('?'|'!')? (':' type)? ('=' assign)? (';' | '}') | mods '[' NAME ':' type ']' ':' type (';' | '}')
mods: ('static'|'async'|'get'|'set'|'*'|'public'|'private'|'protected'|'readonly'|'abstract'|'override'|'declare')*
decorator: '@' NAME ('.' NAME)* ('(' args? ')' | ';')
argdeco: '@' NAME ('.' NAME)* '(' args? ')'
interface: 'interface' NAME typeparams? ('extends' type (',' type)*)? '{' typemember* typelast? '}'
enum: 'const'? 'enum' NAME '{' (key ('=' assign)? (',' key ('=' assign)?)* ','?)? '}'
module: ('namespace'|'module'|'global') (NAME ('.' NAME)* | STR)? block
imports: NAME (',' (names | '*' 'as' NAME))? | names | '*' 'as' NAME
names: '{' ('type'? (NAME|WORD|STR) ('as' (NAME|WORD|STR))? (',' 'type'? (NAME|WORD|STR) ('as' (NAME|WORD|STR))?)* ','?)? '}'
"""

GO = """
file: '^' 'package' NAME ';' (top ';')* top? '$'
top: 'import' (imp | '(' (imp ';')* imp? ')') | 'const' (spec | '(' (spec ';')* spec? ')') | 'var' (spec | '(' (spec ';')* spec? ')') | 'type' (tspec | '(' (tspec ';')* tspec? ')') | 'func' ('(' params? ')')? NAME tparams? sig block?
imp: (NAME|'.')? STR
spec: NAME (',' NAME)* type? ('=' exprs)?
tspec: NAME tparams? '='? type
tparams: '[' NAME (',' NAME)* constraint (',' NAME (',' NAME)* constraint)* ','? ']'
constraint: '~'? type ('|' '~'? type)*
sig: '(' params? ')' (type | '(' params? ')')?
params: param (',' param)* ','?
param: NAME? '...'? type
type: NAME ('.' NAME)? targs? | '*' type | '[' (expr|'...')? ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | 'func' sig | 'struct' '{' (field ';')* field? '}' | 'interface' '{' (elem ';')* elem? '}' | '(' type ')'
targs: '[' type (',' type)* ','? ']'
field: NAME (',' NAME)* type STR? | '*'? NAME ('.' NAME)? targs? STR?
elem: NAME sig | constraint
block: '{' (stmt ';')* stmt? '}'
stmt: top | simple | 'go' expr | 'defer' expr | 'return' exprs? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | block | if | 'switch' (simple? ';')? (simple | NAME ':=' expr)? '{' (('case' (exprs|types) | 'default') ':' (stmt ';')* stmt?)* '}' | 'select' '{' (('case' simple | 'default') ':' (stmt ';')* stmt?)* '}' | 'for' (simple? ';' expr? ';' simple? | expr | (exprs (':='|'='))? 'range' expr)? block | NAME ':' stmt? | ';'
types: type (',' type)*
if: 'if' (simple ';')? expr block ('else' (if | block))?
simple: exprs ((':='|'='|'+='|'-='|'*='|'/='|'%='|'&='|'|='|'^='|'<<='|'>>='|'&^=') exprs)? | expr ('++'|'--') | expr '<-' expr
exprs: expr (',' expr)*
expr: ('-'|'+'|'!'|'^^'|'*'|'&'|'<-')* operand (('+'|'-'|'*'|'/'|'%'|'=='|'!='|'<'|'<='|'>'|'>='|'&&'|'||'|'&'|'|'|'^^'|'<<'|'>>'|'&^') ('-'|'+'|'!'|'^^'|'*'|'&'|'<-')* operand)*
operand: (NAME | NUM | STR | '(' (expr|type) ')' | 'func' sig block | type literal | type '(' expr ')') ('.' (NAME | '(' ('type'|type) ')') | '[' expr? (':' expr? (':' expr)?)? ']' | '[' type (',' type)* ']' | '(' ((expr|type) (',' (expr|type))* '...'? ','?)? ')' | literal)*
literal: '{' (kv (',' kv)* ','?)? '}'
kv: ((expr | literal) ':')? (expr | literal)
"""

RUST = """
file: '^' inner* item* '$'
inner: '#' '!' '[' meta ']'
attr: '#' '[' meta ']'
meta: path ('=' expr | '(' (metas (',' metas)* ','?)? ')')? | 'unsafe' '(' meta ')'
metas: meta | STR | NUM
item: attr* vis? (use | fn | struct | enum | trait | impl | mod | const | alias | 'extern' 'crate' NAME ('as' NAME)? ';' | 'extern' STR? '{' item* '}' | macro) | ';'
vis: 'pub' ('(' ('in'? path | 'crate' | 'self' | 'super') ')')?
use: 'use' '::'? usetree ';'
usetree: (pathseg '::')* (pathseg ('as' NAME)? | '*' | '{' (usetree (',' usetree)* ','?)? '}')
pathseg: NAME | 'crate' | 'self' | 'super' | 'Self'
fn: ('const'|'async'|'unsafe'|'extern' STR?)* 'fn' NAME generics? '(' ((param (',' param)*) ','?)? ')' ('->' type)? where? (block | ';')
param: attr* ('&' LIFE? 'mut'? 'self' | 'mut'? 'self' (':' type)? | pattern ':' type | '...')
generics: '<' (gparam (',' gparam)* ','?)? '>'
gparam: LIFE (':' LIFE ('+' LIFE)*)? | NAME (':' bounds)? ('=' type)? | 'const' NAME ':' type ('=' expr)?
bounds: (bound ('+' bound)*)?
bound: LIFE | '?'? ('for' generics)? path | '(' bound ')'
where: 'where' ((type|LIFE) ':' bounds (',' (type|LIFE) ':' bounds)* ','?)?
struct: ('struct'|'union') NAME generics? where? ('{' (sfield (',' sfield)* ','?)? '}' | '(' (attr* vis? type (',' attr* vis? type)* ','?)? ')' where? ';' | ';')
sfield: attr* vis? NAME ':' type
enum: 'enum' NAME generics? where? '{' (variant (',' variant)* ','?)? '}'
variant: attr* NAME ('{' (sfield (',' sfield)* ','?)? '}' | '(' (vis? type (',' vis? type)* ','?)? ')')? ('=' expr)?
trait: 'unsafe'? 'trait' NAME generics? (':' bounds)? where? '{' item* '}'
impl: 'unsafe'? 'impl' generics? '!'? type ('for' type)? where? '{' item* '}'
mod: 'mod' NAME (';' | '{' inner* item* '}')
const: ('const' | 'static' 'mut'?) NAME ':' type ('=' expr)? ';'
alias: 'type' NAME generics? (':' bounds)? where? ('=' type)? ';'
type: path | '&' LIFE? 'mut'? type | '&&' LIFE? 'mut'? type | '*' ('const'|'mut') type | '[' type (';' expr)? ']' | '(' (type (',' type)* ','?)? ')' | '!' | ('dyn'|'impl') bounds | 'for'? generics? ('unsafe'|'extern' STR?)* 'fn' '(' (type (',' type)* ','?)? ')' ('->' type)? | '_'
path: '::'? ('<' type ('as' path)? '>' '::')? pathseg ('::'? args)? ('::' pathseg ('::'? args)?)*
args: '<' (arg (',' arg)* ','?)? ('>'|'>>') | '(' (type (',' type)*)? ')' ('->' type)?
arg: LIFE | type | NAME '=' type | NAME ':' bounds | NUM | STR | block | '-' NUM | 'true' | 'false'
block: '{' inner* stmt* expr? '}'
stmt: ';' | attr* 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';' | item | attr* expr ';' | attr* blockexpr | macro
blockexpr: ('unsafe'|'async'|'move'|'const')* block | LIFE ':' blockexpr | 'if' cond block ('else' (blockexpr | block))? | 'match' expr '{' (arm)* '}' | 'while' cond block | 'loop' block | 'for' pattern 'in' expr block
cond: expr | 'let' pattern '=' expr (('&&') cond)?
arm: attr* '|'? pattern ('if' expr)? '=>' (expr ',' | blockexpr ','? | expr '}')
macro: path '!' NAME? ('(' soup ')' ';'? | '[' soup ']' ';'? | '{' soup '}')
soup: (part ((',' | ';' | '=>') part)* (',' | ';')?)?
part: expr | 'let' pattern | stmt* expr | pattern ('if' expr)? | type | 'move'? block
pattern: '|'? pat ('|' pat)*
pat: '_' | '..' | 'ref'? 'mut'? NAME ('@' pat)? | '-'? (NUM) (('..='|'..'|'...') '-'? NUM?)? | STR (('..='|'...') STR)? | 'true' | 'false' | '&' 'mut'? pat | '&&' pat | '(' (pattern (',' pattern)* ','?)? ')' | '[' (pattern (',' pattern)* ','?)? ']' | path ('(' (pattern (',' pattern)* ','?)? ')' | '{' ((attr* 'ref'? 'mut'? NAME (':' pattern)? | '..') (',' ('ref'? 'mut'? NAME (':' pattern)? | '..'))* ','?)? '}')? | '..=' NUM | macro
expr: ('-'|'!'|'*'|'&' 'mut'?|'&&' 'mut'?)* operand (binop ('-'|'!'|'*'|'&' 'mut'?|'&&' 'mut'?)* operand)* | 'return' expr? | 'break' LIFE? expr? | 'continue' LIFE? | ('move'|'async'|'static')* ('||' | '|' (cparam (',' cparam)* ','?)? '|') ('->' type block | expr) | '..'|'..=' expr
cparam: pat (':' type)?
binop: '+'|'-'|'*'|'/'|'%'|'=='|'!='|'<'|'<='|'>'|'>='|'&&'|'||'|'&'|'|'|'^^'|'<<'|'>>'|'='|'+='|'-='|'*='|'/='|'%='|'&='|'|='|'^='|'<<='|'>>='|'..'|'..='
operand: (NUM | STR | 'true' | 'false' | path | '(' (expr (',' expr)* ','?)? ')' | '[' (expr (',' expr)* ','? | expr ';' expr)? ']' | blockexpr | macro | path '{' ((attr* (NAME|NUM) (':' expr)? | '..' expr?) (',' (attr* (NAME|NUM) (':' expr)? | '..' expr?))* ','?)? '}' | 'return' | 'break' | 'continue') ('?' | '.' (NAME ('::' args)? | NUM | 'await') | '(' (expr (',' expr)* ','?)? ')' | '[' expr ']' | 'as' type | '..')*
"""

JAVA = """
file: '^' anno* ('package' qname ';')? ('import' 'static'? qname ('.' '*')? ';' | ';')* top* '$'
top: typedecl | ';' | mods 'module' qname '{' (NAME* qname ';')* '}' | member
qname: NAME ('.' NAME)*
anno: '@' qname ('(' (elem (',' elem)*)? ')')?
elem: (NAME '=')? (expr | anno | '{' ((expr|anno) (',' (expr|anno))* ','?)? '}')
mods: (anno | 'public'|'private'|'protected'|'static'|'final'|'abstract'|'native'|'synchronized'|'transient'|'volatile'|'strictfp'|'default'|'sealed'|'non-sealed')*
typedecl: mods ('class' NAME tparams? ('extends' type)? ('implements' types)? ('permits' types)? body | 'interface' NAME tparams? ('extends' types)? ('permits' types)? body | 'enum' NAME ('implements' types)? '{' (const (',' const)*)? ','? (';' member*)? '}' | 'record' NAME tparams? '(' params? ')' ('implements' types)? body | '@' 'interface' NAME body)
const: anno* NAME ('(' args? ')')? body?
body: '{' member* '}'
types: type (',' type)*
tparams: '<' tparam (',' tparam)* '>'
tparam: anno* NAME ('extends' type ('&' type)*)?
type: anno* (PRIM | NAME targs? ('.' anno* NAME targs?)*) (anno* '[' ']')*
targs: '<' (targ (',' targ)*)? ('>'|'>>'|'>>>')
targ: anno* '?' (('extends'|'super') type)? | type
member: ';' | 'static'? block | mods tparams? (type|'void') NAME '(' params? ')' ('[' ']')* ('throws' types)? (block | 'default' elem ';' | ';') | mods tparams? NAME '(' params? ')' ('throws' types)? block | mods NAME block | mods type var (',' var)* ';' | typedecl
var: NAME ('[' ']')* ('=' init)?
init: expr | arrayinit
arrayinit: '{' (init (',' init)* ','?)? '}'
params: param (',' param)*
param: ('final'|anno)* type '...'? (NAME ('.' 'this')? | 'this') ('[' ']')*
block: '{' stmt* '}'
stmt: ';' | block | mods type var (',' var)* ';' | typedecl | expr ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' (mods type var (',' var)* | expr (',' expr)*)? ';' expr? ';' (expr (',' expr)*)? ')' stmt | 'for' '(' mods type NAME ':' expr ')' stmt | 'return' expr? ';' | 'throw' expr ';' | 'break' NAME? ';' | 'continue' NAME? ';' | 'yield' expr ';' | 'assert' expr (':' expr)? ';' | 'try' ('(' res (';' res)* ';'? ')')? block ('catch' '(' ('final'|anno)* type ('|' type)* NAME ')' block)* ('finally' block)? | 'switch' '(' expr ')' switchbody | 'synchronized' '(' expr ')' block | NAME ':' stmt
res: mods type NAME '=' expr | expr
switchbody: '{' (label (':' stmt* | '->' (expr ';' | block | 'throw' expr ';')))* '}'
label: 'case' caseitem (',' caseitem)* ('when' expr)? | 'default'
caseitem: expr | type NAME | type '(' (caseitem (',' caseitem)*)? ')' | 'default'
expr: tern (('='|'+='|'-='|'*='|'/='|'%='|'&='|'|='|'^='|'<<='|'>>='|'>>>=') expr)? | lambda
lambda: (NAME | '(' (params | NAME (',' NAME)*)? ')') '->' (expr | block)
tern: unary (binop unary | 'instanceof' 'final'? type (NAME | '(' (caseitem (',' caseitem)*)? ')')?)* ('?' expr ':' (tern|lambda))?
binop: '+'|'-'|'*'|'/'|'%'|'=='|'!='|'<'|'<='|'>'|'>='|'&&'|'||'|'&'|'|'|'^^'|'<<'|'>>'|'>>>'
unary: ('+'|'-'|'!'|'~'|'++'|'--'|'(' type ('&' type)* ')')* (postfix|lambda) ('++'|'--')?
postfix: primary ('.' (targs? NAME | 'new' creator | 'this' | 'super' | 'class') | '[' expr ']' | '(' args? ')' | '::' (targs? NAME | 'new') | 'switch')*
primary: NAME | NUM | STR | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr ')' | 'new' creator | type '::' ('new'|NAME) | (type|'void') '.' 'class' | 'switch' '(' expr ')' switchbody
creator: anno* (NAME|PRIM) targs? ('.' NAME targs?)* ('(' args? ')' body? | ('[' expr ']')+ ('[' ']')* | ('[' ']')+ arrayinit)
args: expr (',' expr)*
"""

PYTHON = """
file: '^' stmt* '$'
stmt: simple (';' simple)* ';' | ';' | compound | deco ';'
deco: '@' named
block: simple (';' simple)* ';' | ';' INDENT stmt+ DEDENT
simple: exprs (':' expr ('=' value)?)? | exprs (augop value)? | exprs ('=' (exprs|yield))+ | yield | 'return' exprs? | 'raise' (expr ('from' expr)?)? | 'pass' | 'break' | 'continue' | 'del' exprs | 'assert' expr (',' expr)? | 'global' NAME (',' NAME)* | 'nonlocal' NAME (',' NAME)* | 'import' dotted ('as' NAME)? (',' dotted ('as' NAME)?)* | 'from' ('.'|'...')* dotted? 'import' ('*' | names | '(' names ','? ')') | 'type' NAME tparams? '=' expr
names: NAME ('as' NAME)? (',' NAME ('as' NAME)?)*
dotted: NAME ('.' NAME)*
value: exprs | yield
augop: '+='|'-='|'*='|'/='|'//='|'%='|'@='|'&='|'|='|'^='|'>>='|'<<='|'**='
yield: 'yield' ('from' expr | exprs)?
compound: 'if' named ':' block | 'elif' named ':' block | 'else' ':' block | 'while' named ':' block | 'async'? 'for' exprs 'in' exprs ':' block | 'try' ':' block | 'except' '*'? (exprs ('as' NAME)?)? ':' block | 'finally' ':' block | 'async'? 'with' (items | '(' items ','? ')') ':' block | 'async'? 'def' NAME tparams? '(' params? ')' ('->' exprs)? ':' block | 'class' NAME tparams? ('(' args? ')')? ':' block | 'match' exprs ':' block | 'case' patterns ('if' named)? ':' block
items: expr ('as' expr)? (',' expr ('as' expr)?)*
tparams: '[' ('*'|'**')? NAME (':' expr)? ('=' expr)? (',' ('*'|'**')? NAME (':' expr)? ('=' expr)?)* ','? ']'
params: param (',' param)* ','?
param: '/' | '*' | ('*'|'**')? NAME (':' '*'? expr)? ('=' expr)?
exprs: star (',' star)* ','?
star: '*'? named
named: expr (':=' expr)?
expr: or ('if' or 'else' expr)? | 'lambda' params? ':' expr
or: not (('and'|'or') not)*
not: 'not'* cmp
cmp: bit (('<'|'>'|'=='|'>='|'<='|'!='|'in'|'not' 'in'|'is'|'is' 'not') bit)*
bit: ('+'|'-'|'~')* power (('+'|'-'|'*'|'/'|'//'|'%'|'@'|'&'|'|'|'^^'|'<<'|'>>'|'**') ('+'|'-'|'~')* power)*
power: 'await'? atom ('.' NAME | '(' args? ')' | '[' slices ']')*
atom: NAME | NUM | STR+ | 'True' | 'False' | 'None' | '...' | '(' (exprs | yield | named comp)? ')' | '[' (exprs | named comp)? ']' | '{' (entry (',' entry)* ','? | entry comp)? '}'
entry: expr ':' expr | '**' bit | star
comp: ('async'? 'for' exprs 'in' or ('if' or)*)+
args: arg (',' arg)* ','? | named comp
arg: NAME '=' expr | ('*'|'**')? named
slices: slice (',' slice)* ','?
slice: star | expr? ':' expr? (':' expr?)?
patterns: pattern (',' pattern)* ','?
pattern: orpat ('as' NAME)?
orpat: pat ('|' pat)*
pat: '-'? NUM (('+'|'-') NUM)? | STR+ | 'None' | 'True' | 'False' | dotted ('(' ((NAME '=')? pattern (',' (NAME '=')? pattern)* ','?)? ')')? | '(' patterns? ')' | '[' patterns? ']' | '{' ((STR|'-'? NUM|dotted|'None'|'True'|'False') ':' pattern (',' (STR|NUM|dotted) ':' pattern)* (',' '**' NAME)? ','? | '**' NAME)? '}' | '*' NAME
"""

GRAMMARS = {"py": PYTHON, "js": JAVASCRIPT, "ts": TYPESCRIPT, "go": GO, "rs": RUST, "java": JAVA}

# Words that are keywords in some places only and names elsewhere.
SOFT = {
    "py": {"match", "case", "type"},
    "js": {"async", "of", "get", "set", "from", "as", "static", "let", "yield", "await"},
    "ts": {
        "async", "of", "get", "set", "from", "as", "static", "let", "yield", "await", "type", "interface", "namespace", "module", "declare", "abstract", "readonly", "override",
        "keyof", "infer", "is", "asserts", "unique", "satisfies", "global", "public", "private", "protected", "implements",
    },
    "go": set(),
    "rs": {"union"},
    "java": {"module", "record", "sealed", "permits", "yield", "when", "non-sealed"},
}
#: Primitive types of Java.
PRIMITIVES = ("boolean", "byte", "char", "short", "int", "long", "float", "double", "var")


class Node:
    """What a piece of a grammar can begin and end with, and whether it can be empty."""

    def __init__(self, first: set[str], last: set[str], empty: bool):
        self.first, self.last, self.empty = first, last, empty


def adjacent(grammar: str) -> set[tuple[str, str]]:
    """The pairs of tokens that can stand next to each other in some text of ``grammar``.

    First and last tokens of all rules are found by repetition until nothing is added; the pairs are then those of the last
    tokens of one part of a sequence with the first tokens of the next part that need not be passed over.
    """
    rules = {name: body for line in grammar.strip().splitlines() if line.strip() for name, body in [line.split(": ", 1)]}
    known = {name: Node(set(), set(), False) for name in rules}
    pairs: set[tuple[str, str]] = set()
    tokens = {name: re.findall(r"'(?:[^']+)'|[A-Za-z_]+|[()|?*+]", body) for name, body in rules.items()}

    def choice(words: list[str], at: int) -> tuple[Node, int]:
        node, at = sequence(words, at)
        while at < len(words) and words[at] == "|":
            other, at = sequence(words, at + 1)
            node = Node(node.first | other.first, node.last | other.last, node.empty or other.empty)
        return node, at

    def sequence(words: list[str], at: int) -> tuple[Node, int]:
        whole = Node(set(), set(), True)
        while at < len(words) and words[at] not in ("|", ")"):
            part, at = piece(words, at)
            pairs.update((a, b) for a in whole.last for b in part.first)
            whole = Node(whole.first | part.first if whole.empty else whole.first, whole.last | part.last if part.empty else part.last, whole.empty and part.empty)
        return whole, at

    def piece(words: list[str], at: int) -> tuple[Node, int]:
        word = words[at]
        if word == "(":
            node, at = choice(words, at + 1)
        elif word in known:
            node = known[word]
        else:
            token = word.strip("'")
            node = Node({token}, {token}, False)
        at += 1
        while at < len(words) and words[at] in "?*+":
            if words[at] in "*+":
                pairs.update((a, b) for a in node.last for b in node.first)
            node = Node(node.first, node.last, node.empty or words[at] in "?*")
            at += 1
        return node, at

    while True:
        before = len(pairs) + sum(len(n.first) + len(n.last) + n.empty for n in known.values())
        for name, words in tokens.items():
            node, _ = choice(words, 0)
            old = known[name]
            known[name] = Node(old.first | node.first, old.last | node.last, old.empty or node.empty)
        if len(pairs) + sum(len(n.first) + len(n.last) + n.empty for n in known.values()) == before:
            return pairs


@cache
def alphabet(lang: str) -> dict[str, str]:
    """One character for every token of a language: classes and single signs are themselves, others get one of their own."""
    tokens = sorted({t for pair in adjacent(GRAMMARS[lang]) for t in pair})
    classes = {"NAME": "n", "NUM": "0", "STR": "s", "WORD": "w", "PRIVATE": "h", "REGEX": "x", "TPL": "q", "INDENT": "⇥", "DEDENT": "⇤", "LIFE": "l", "PRIM": "t", "^": "\x02", "$": "\x03", "^^": "^"}
    codes = dict(classes)
    free = 0xE000
    for token in tokens:
        if token not in codes:
            if len(token) == 1 and not token.isalnum() and token != "_":
                codes[token] = token
            else:
                codes[token], free = chr(free), free + 1
    return codes


@cache
def permissible(lang: str) -> frozenset[str]:
    """The permissible pairs of a language as texts of two characters; names stand for soft keywords as well."""
    codes = alphabet(lang)
    soft = [codes[w] for w in SOFT[lang] if w in codes]
    found = {codes[a] + codes[b] for a, b in adjacent(GRAMMARS[lang])}
    found |= {c + p[1] for p in found if p[0] == "n" for c in soft}
    found |= {p[0] + c for p in found if p[1] == "n" for c in soft}
    return frozenset(found)
