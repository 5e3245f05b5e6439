"""What each signal of a language looks for, said in tokens.

A text is read as its tokens first (``streams``): comments are gone, a literal is its opening quote, and what is left stands
with one blank between tokens. A construct is then written down as the tokens that make it up, so nothing in a comment or a
literal is ever taken for code, and spacing never matters. In a construct

* a word or sign is itself, ``a|b`` is either of two, ``Register*Server`` a name of that shape;
* NAME is a name (``NAME-x``: any but x), TYPE a name with a capital, NUMBER a number, TEXT a literal, BLOCK a text block;
* LINE is the end of the line before; constructs that name it are looked for among lines, others whatever the lines;
* GAP is anything within a statement, LABEL anything up to a colon, ARGS anything within a list, BODY anything up to ``}``;
* after COMMENT stands a word of a comment.

Several constructs in a tuple are alternatives. A signal lists the constructs found, in order, or says which of two are there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = r"[A-Za-z_]\w*"

#: A token each; groups: comment, then what stands for a literal (its opening quote), then any other token or line end.
#: Loops over groups are possessive, so that long literals need no stack.
SIGNS = r"<=>|\.\.\.|->|=>|<-|::|:=|\+\+|--|&&|\|\||\?\.|[-+*/%&|^!=<>]="
OTHER = rf"([\p{{L}}_$][\w$]*+|\d(?:[\w.]|'(?=\d))*+|{SIGNS}|\n|\S)|[^\S\n]+"
QUOTED = "|".join(rf"({q})[^{q}\\\n]*+(?:\\(?s:.)[^{q}\\\n]*+)*+{q}?" for q in "\"'")
BRACES = rf'(?U)(//[^\n]*+|/\*(?s:.*?)(?:\*/|\z))|(""")(?s:.*?)(?:"""|\z)|{QUOTED}|(`)[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`?|{OTHER}'
PYTHON = rf"(?U)(#[^\n]*+)|(\"\"\"|''')(?s:.*?)(?:\2|\z)|{QUOTED}|(\x00)|{OTHER}"

KINDS = {"NAME": r"[\p{L}_$][\w$]*", "TYPE": r"\p{Lu}[\w$]*", "NUMBER": r"\d[^ ]*", "TEXT": "[\"'`]", "BLOCK": '"""', "LINE": r"\n"}
GAPS = {"GAP": r"[^;{}\n]*?(?<= )", "LABEL": r"[^:;{}]*?(?<= )", "ARGS": r"[^(){};]*?(?<= )", "BODY": r"[^}]*?(?<= )"}

Construct = str | tuple[str, ...]


def streams(code: Column, language: Column) -> Column:
    """struct<flat, lined, notes> of texts: the tokens, the tokens with line ends, the words of comments. In Go a line's end
    is a token, except after what can't end a statement; so flat is lined there."""
    read = lambda kept: F.when(language == "python", F.regexp_replace(code, PYTHON, kept)).otherwise(F.regexp_replace(code, BRACES, kept))
    single = lambda text: F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), " +", " ")
    lined = single(F.concat(F.lit("\n "), read(" $2$3$4$5$6 "), F.lit(" \n")))
    flat = F.when(language == "go", F.regexp_replace(lined, r"(?<= [(,]) \n(?: \n)*+", "")).otherwise(F.regexp_replace(lined, r" \n", ""))
    return F.struct(flat.alias("flat"), lined.alias("lined"), F.regexp_replace(F.concat(F.lit(" "), read(" $1 "), F.lit(" ")), r"\s+", " ").alias("notes"))


def token(item: str) -> str:
    kind, _, but = item.partition("-")
    if kind in KINDS:
        return (rf"(?!{re.escape(but)} )" if but else "") + KINDS[kind]
    return r"[\w$]+".join(map(re.escape, item.split("*"))) if len(item) > 2 and "*" in item else re.escape(item)


def regex(construct: str, named: bool = False) -> str:
    """The expression that finds a construct in a stream; ``named``: its last token is a group."""
    items = construct.split()
    items = items[1:] if items[0] == "COMMENT" else items
    out = ["(?<= )"]
    for i, item in enumerate(items):
        group = "(" if named and i == len(items) - 1 else "(?:"
        out.append(GAPS[item] if item in GAPS else group + "|".join(map(token, item.split("|"))) + ") ")
    return "".join(out)


def stream_of(construct: str) -> str:
    return "notes" if construct.startswith("COMMENT ") else "lined" if "LINE" in construct else "flat"


def found(text: Column, construct: Construct) -> Column:
    """Whether streams hold a construct."""
    by_stream: dict[str, list[str]] = {}
    for one in (construct,) if isinstance(construct, str) else construct:
        by_stream.setdefault(stream_of(one), []).append(regex(one))
    out = F.lit(False)
    for name, expressions in by_stream.items():
        out = out | text[name].rlike("(?U)" + "|".join(expressions))
    return out


def names(text: Column, construct: str) -> Column:
    """The last tokens of all places where streams hold a construct."""
    return F.regexp_extract_all(text[stream_of(construct)], F.lit("(?U)" + regex(construct, named=True)), 1)


@dataclass(frozen=True)
class Listed:
    """The names of the constructs found, or ``none``."""

    key: str
    confidence: float
    parts: dict[str, Construct]
    none: str = "none"


@dataclass(frozen=True)
class Present:
    key: str
    confidence: float
    construct: Construct


@dataclass(frozen=True)
class Either:
    """Which of two are there: the one, the other, both or none."""

    key: str
    confidence: float
    first: tuple[str, Construct]
    second: tuple[str, Construct]
    both: str = "both"


@dataclass(frozen=True)
class First:
    """The first of the constructs found; without any, ``none``, or no signal at all."""

    key: str
    confidence: float
    parts: dict[str, Construct]
    none: str | None = "none"


@dataclass(frozen=True)
class Names:
    """The different last tokens of a construct, in order."""

    key: str
    confidence: float
    construct: str
    none: str | None = "none"


# ---- Fixed values: keys, confidences, the names of constructs and their order, and the names that they look for.

ROUTES = ("express|Router ( )", "app|router . get|post|put|delete|patch (")

C = (
    Listed("c.preprocessor", 0.95, {"include": "LINE # include", "define": "LINE # define", "conditional": "LINE # if|ifdef|ifndef"}),
    Listed("c.pointer_usage", 0.90, {"dereference": "* NAME", "address_of": "(|[|{|,|;|=|?|:|!|==|!=|&&|return & NAME", "arithmetic": ("NAME ++|--", "NAME +=|-=", "NAME +|- NUMBER")}),
    Listed("c.composite_types", 0.90, {"struct": "struct NAME", "union": "union NAME", "enum": "enum NAME", "typedef": "typedef"}),
    Either("c.memory_management", 0.90, ("alloc_only", "malloc|calloc|realloc ("), ("free_only", "free ("), "alloc_free"),
    Listed("c.control_flow", 0.90, {"goto": "goto NAME", "function_pointer": "( * NAME ) (", "switch": "switch ("}),
    Listed("c.c23_features", 0.90, {"constexpr": "constexpr", "nullptr": "nullptr", "typeof": "typeof (", "static_assert": "static_assert|_Static_assert (", "embed": "LINE # embed", "attributes": "[ [ NAME", "bool": "bool"}),
)

CPP = (
    Present("cpp.template.present", 0.95, "template <"),
    Either("cpp.virtual_override", 0.90, ("virtual", "virtual"), ("override", "override")),
    Names("cpp.namespace", 0.90, "namespace NAME"),
    Either("cpp.const_correctness", 0.85, ("const_method", ") const"), ("constexpr", "constexpr")),
    Listed("cpp.modern_features", 0.90, {"concept": "concept NAME", "requires": "requires", "coroutine": "co_await|co_yield|co_return", "module": ("LINE module|import NAME", "LINE export module|import NAME"), "spaceship": "<=>", "consteval": "consteval", "constinit": "constinit"}),
)

JAVA = (
    Names("java.annotations", 0.95, "LINE @ NAME-interface"),
    Listed("java.access_modifiers", 0.90, {x: x for x in ("public", "private", "protected")}, "package"),
    Present("java.generic.present", 0.90, ("< TYPE >|,|<|.|[|&|extends", "< ? >|extends|super")),
    Either("java.exception_handling", 0.90, ("throws", "throws NAME"), ("try_catch", ("try {|(", "catch ("))),
    Either("java.functional_style", 0.85, ("stream", ". stream|map|filter|collect ("), ("lambda", (") ->", "(|,|=|?|:|return NAME ->")), "stream_lambda"),
    First("java.class_kind", 0.90, {"interface": "interface NAME", "abstract": "abstract class", "class": "class NAME"}),
    Listed("java.modern_features", 0.90, {"record": "record NAME (|<", "sealed": "sealed class|interface|abstract", "pattern_instanceof": "instanceof NAME NAME", "switch_expression": ("case LABEL ->", "default ->"), "text_block": "BLOCK", "var": "var NAME"}),
    Listed("java.spring_stereotypes", 0.90, {"rest_controller": "@ RestController", "controller": "@ Controller", "service": "@ Service", "repository": "@ Repository", "component": "@ Component", "configuration": "@ Configuration"}),
    Listed("java.rest_http_patterns", 0.90, {"mapping": "@ RequestMapping|GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping", "response_entity": "ResponseEntity", "path_variable": "@ PathVariable", "request_body": "@ RequestBody", "request_param": "@ RequestParam"}),
    Listed("java.persistence_jpa", 0.90, {"entity": "@ Entity", "table": "@ Table", "column": "@ Column", "repository_interface": "extends GAP JpaRepository|CrudRepository|PagingAndSortingRepository", "entity_manager": "EntityManager", "transactional": "@ Transactional", "query": "@ Query"}),
    Listed("java.dependency_injection", 0.90, {"autowired": "@ Autowired", "inject": "@ Inject", "bean": "@ Bean", "qualifier": "@ Qualifier", "value": "@ Value ("}),
    Listed("java.async_reactive", 0.90, {"completable_future": "CompletableFuture", "executor_service": "ExecutorService", "mono": "Mono <", "flux": "Flux <", "async": "@ Async", "scheduled": "@ Scheduled"}),
)

GO = (
    Listed("go.concurrency", 0.90, {"goroutine": ("go func", "go NAME (|."), "channel": ("make ( chan", "<-"), "select": "select {"}),
    Listed("go.error_handling", 0.90, {"err_nil_check": "if|;|(|&& err != nil", "error_creation": ("errors . New", "fmt . Errorf"), "error_return": "return GAP err"}),
    Listed("go.interface_usage", 0.85, {"declaration": "interface {", "type_assertion": ". ( NAME-type|*|[", "type_switch": "switch GAP . ( type )"}),
    Present("go.struct_embedding", 0.85, ("struct { BODY LINE TYPE LINE", "struct { BODY LINE * TYPE LINE", "struct { BODY LINE NAME . TYPE LINE", "struct { BODY LINE * NAME . TYPE LINE")),
    Either("go.receiver_style", 0.90, ("pointer", ("func ( NAME * NAME ) NAME-func (", "func ( * NAME ) NAME-func (", "func ( NAME * NAME [")), ("value", ("func ( NAME NAME ) NAME-func (", "func ( NAME ) NAME-func (", "func ( NAME NAME [ ARGS ) NAME-func (")), "mixed"),
    Listed("go.defer_recover", 0.90, {"defer": "defer", "panic": "panic (", "recover": "recover ("}),
    Listed("go.modern_features", 0.90, {"generics": ("[ NAME any|comparable|constraints|cmp|interface|~", "[ NAME , NAME any|comparable|constraints|cmp|interface|~"), "go_embed": "COMMENT //go:embed", "range_over_int": "range NUMBER", "range_over_func": "range NAME-len ("}),
    Listed("go.context_usage", 0.90, {"param": ("func NAME ( ARGS context . Context", "func ( ARGS context . Context"), **{f"with_{x.lower()}": f"context . With{x}" for x in ("Cancel", "Timeout", "Deadline", "Value")}, "background": "context . Background ( )", "todo": "context . TODO ( )"}),
    Listed("go.http_patterns", 0.90, {"handler": ("http . HandlerFunc|Handler|ResponseWriter", "ServeHTTP ("), "listener": "http . ListenAndServe|ListenAndServeTLS (", "mux": ("http . NewServeMux", "chi . NewRouter", "gin . Default", "echo . New"), "middleware": "func GAP http . Handler ) http . Handler"}),
    Listed("go.grpc_patterns", 0.90, {"server": "grpc . NewServer (", "service_registry": "Register*Server (", "client": "grpc . Dial|NewClient ("}),
    Listed("go.sync_primitives", 0.90, {"mutex": "sync . Mutex|RWMutex", "waitgroup": "sync . WaitGroup", "once": "sync . Once"}),
    Present("go.init_functions", 0.85, "func init ( )"),
)

#: Where only a type can stand behind a colon; between braces a colon may be a literal's.
TYPED = ("( NAME : NAME|{|[|(", "( NAME ? :", "const|let|var NAME :", "public|private|protected|readonly NAME :", ") NAME : NAME", ") : NAME {|=>|<|[", "interface NAME {|<|extends", "type NAME =|<")
JAVASCRIPT = (
    Present("javascript.async.present", 0.95, ("async function|(", "async NAME (|=>", "await")),
    First("javascript.type_system", 0.85, {"flow": "COMMENT @flow|//@flow|/*@flow", "typescript": TYPED, "jsdoc": "COMMENT @type|@param|@return|@returns|@typedef"}),
    Either("javascript.module_system", 0.95, ("esm", "import|export NAME|{|*|TEXT"), ("commonjs", ("require (", "module . exports", "exports . NAME")), "mixed"),
    First("javascript.class_pattern", 0.90, {"class": "class NAME", "prototype": ". prototype .|=|["}, None),
    Names("javascript.decorators.present", 0.95, "LINE @ NAME", None),
    Listed("javascript.http_framework", 0.90, {"express": ROUTES, "fastify": ("Fastify|fastify (", "fastify . get|post|register|decorate|addHook ("), "koa": "new Koa (", "hapi": "Hapi . server|Server (", "native_http": "http|https . createServer ("}),
    Listed("javascript.middleware_patterns", 0.90, {"body_parser": "bodyParser|express . json|urlencoded (", "cors": "cors (", "helmet": "helmet (", "morgan": "morgan (", "error_handler": "( err , req , res , next )", "static_files": "express . static ("}),
    Listed("javascript.database_client", 0.90, {"mongoose": ("mongoose . Schema|model|connect", "new Schema ("), "sequelize": ("new Sequelize (", "sequelize . define (", "DataTypes ."), "knex": ("knex (", "knex . schema|migrate ."), "mongodb_native": "MongoClient", "redis": ("new Redis (", "redis . createClient ("), "prisma": ("PrismaClient", "prisma . NAME . findMany|create|update|delete (")}),
    Listed("javascript.auth_patterns", 0.90, {"jwt": "jwt . sign|verify|decode (", "passport": "passport . authenticate|use|initialize|session (", "bcrypt": "bcrypt . hash|compare|genSalt|hashSync|compareSync (", "oauth": "OAuth2Client|OAuth2Strategy", "session_auth": ("req . session", "req . isAuthenticated (")}),
    Listed("javascript.realtime_messaging", 0.90, {"socketio": ("socket . join|leave (", "io . of|to|emit (", "io . on ( TEXT"), "websocket": ("new WebSocket (", "WebSocketServer"), "event_emitter": "EventEmitter", "message_queue": ("channel . sendToQueue|consume|assertQueue (", "amqp . connect (")}),
)

TYPESCRIPT = (
    Present("typescript.strict_mode", 0.85, (")|]|} as NAME", "=|(|.|return NAME as NAME", "as any|unknown|const|string|number|boolean|never|object", "NAME|)|] ! .|[|;|)|,", "NAME|)|? : string|number|boolean|void|any|never|unknown")),
    Present("typescript.generic.present", 0.90, ("< TYPE >|,|<|.|[|=|extends", "TYPE < NAME >|,|[|<", "function|class|interface|type NAME <")),
    Listed("typescript.framework_decorators", 0.90, {"controller": "@ Controller (", "injectable": "@ Injectable (", "module": "@ Module (", "guard": "@ UseGuards (", "pipe": "@ UsePipes (", "interceptor": "@ UseInterceptors ("}),
    Listed("typescript.rest_http_patterns", 0.90, {"http_method": "@ Get|Post|Put|Delete|Patch|Head|Options|All (", "param_decorator": "@ Param|Query|Body|Headers (", "status_header": "@ HttpCode|Header (", "express_router": ROUTES, "fastify": ("Fastify|fastify (", ". register (")}),
    Listed("typescript.orm_persistence", 0.90, {"typeorm_entity": "@ Entity (", "typeorm_column": "@ Column|PrimaryGeneratedColumn|PrimaryColumn (", "typeorm_relation": "@ OneToMany|ManyToOne|OneToOne|ManyToMany (", "typeorm_repository": ("Repository <", "getRepository (", "@ InjectRepository ("), "prisma": ("PrismaClient", "prisma . NAME . findMany|findUnique|create|update|delete ("), "mongoose": ("mongoose . Schema", "mongoose . model (", "new Schema (")}),
    Listed("typescript.dependency_injection", 0.90, {"inject": "@ Inject (", "nest_inject": "@ InjectRepository|InjectModel|InjectConnection (", "inversify": "@ injectable|inject (", "provide": "useFactory|useClass|useValue :"}),
    Listed("typescript.reactive_rxjs", 0.90, {"observable": "Observable <", "subject": "Subject|BehaviorSubject|ReplaySubject <", "pipe": ". pipe (", "operators": "switchMap|mergeMap|concatMap|exhaustMap|catchError ("}),
)

BY_LANGUAGE = {"c": C, "cpp": CPP, "java": JAVA, "go": GO, "javascript": JAVASCRIPT, "typescript": JAVASCRIPT + TYPESCRIPT, "python": ()}

#: Words that stand before a name without being its type.
NO_TYPE = "return else new delete in is not and or if elif import from as await yield throw throws goto case package using go defer of typeof instanceof raise assert del lambda class def func function".split()
KINDS["WORD"] = rf"(?!(?:{'|'.join(NO_TYPE)}) ){KINDS['NAME']}"
#: What any language may show: a name with a type behind a colon, or a type before a name that a list, a statement or a value
#: follows; an addition of two names; an operator + of one's own.
HINTS = ("NAME : NAME", "WORD|> NAME ,|)|;|=", "WORD|> *|&|&& NAME ,|)|;|=", "] WORD NAME ,|)|;|=")
ADDED = "NAME + NAME"
OWN_PLUS = "operator + ("
USER_TYPE = "class|struct NAME"

#: Types that come with C++, and words before a type that aren't part of it.
PRIMITIVE = frozenset({
    "auto", "bool", "char", "char8_t", "char16_t", "char32_t", "double", "float", "int", "long", "long double", "long long", "short", "signed", "signed char", "signed int", "signed long",
    "signed long long", "signed short", "size_t", "std::size_t", "std::string", "unsigned", "unsigned char", "unsigned int", "unsigned long", "unsigned long long", "unsigned short", "void", "wchar_t",
})
QUALIFIERS = frozenset({"const", "constexpr", "volatile", "static", "inline", "friend", "typename", "mutable", "register"})
