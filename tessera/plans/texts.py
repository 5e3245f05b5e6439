"""Texts in every language, and the signals that each must show, told by reading them."""

from __future__ import annotations

#: For each language texts, and for each text its signals: key, value and confidence; {n} stands for a part's number. The
#: last text of a language has comments, literals and spacing that must not matter.
TEXTS: dict[str, list[tuple[str, list[tuple[str, str, float]]]]] = {
    'c': [
        (
            '#include <a.h>\n#ifdef X\nstruct p { int *q; };\nvoid f(void) { p = malloc(4); goto end; if (&x) { *p = a[1]; i++; } }',
            [('c.c23_features', 'none', 0.9), ('c.composite_types', 'struct', 0.9), ('c.control_flow', 'goto', 0.9), ('c.memory_management', 'alloc_only', 0.9), ('c.pointer_usage', 'dereference,address_of,arithmetic', 0.9), ('c.preprocessor', 'include,conditional', 0.95), ('typing.channel', 'annotated', 0.65)],
        ),
        (
            'int x;',
            [('c.c23_features', 'none', 0.9), ('c.composite_types', 'none', 0.9), ('c.control_flow', 'none', 0.9), ('c.memory_management', 'none', 0.9), ('c.pointer_usage', 'none', 0.9), ('c.preprocessor', 'none', 0.95), ('typing.channel', 'annotated', 0.65)],
        ),
        (
            '// struct a; malloc(1); goto x;\nchar *s = "free(x); #define A";\n/* union u\n#include <x.h> */\nint y = a & b && c;\nchar q = \'"\'; enum\n e { A };',
            [('c.c23_features', 'none', 0.9), ('c.composite_types', 'enum', 0.9), ('c.control_flow', 'none', 0.9), ('c.memory_management', 'none', 0.9), ('c.pointer_usage', 'dereference', 0.9), ('c.preprocessor', 'none', 0.95), ('typing.channel', 'annotated', 0.65)],
        ),
    ],
    'cpp': [
        (
            'namespace b { }\nnamespace a {\ntemplate <class T> class V { virtual int g() const; V operator+(V o); };\nV add(V x, V y) { return x + y; }\nint n = 1; }',
            [('cpp.const_correctness', 'const_method', 0.85), ('cpp.modern_features', 'none', 0.9), ('cpp.namespace', 'a,b', 0.9), ('cpp.template.present', 'yes', 0.95), ('cpp.virtual_override', 'virtual', 0.9), ('operator.plus.binding', 'user_defined_overload', 0.95), ('operator.plus.declared', 'yes', 0.95), ('operator.plus.present', 'yes', 0.8), ('typing.channel', 'annotated', 0.65), ('typing.user_types.present', 'yes', 0.9)],
        ),
        (
            'int f(int a, int b) {\n return a + b;\n}',
            [('cpp.const_correctness', 'none', 0.85), ('cpp.modern_features', 'none', 0.9), ('cpp.namespace', 'none', 0.9), ('cpp.template.present', 'no', 0.95), ('cpp.virtual_override', 'none', 0.9), ('operator.plus.binding', 'builtin', 0.9), ('operator.plus.present', 'yes', 0.8), ('typing.channel', 'annotated', 0.65)],
        ),
        (
            '// namespace no {\nconst char* t = "virtual template <class T> co_await";\nnamespace  yes{n}\n{ bool b = x <=> y; }',
            [('cpp.const_correctness', 'none', 0.85), ('cpp.modern_features', 'spaceship', 0.9), ('cpp.namespace', 'yes{n}', 0.9), ('cpp.template.present', 'no', 0.95), ('cpp.virtual_override', 'none', 0.9), ('typing.channel', 'annotated', 0.65)],
        ),
    ],
    'java': [
        (
            '@Service\npublic class A {\n @GetMapping("/x") private List<String> f(@PathVariable int a) throws E { try { var y = xs.stream().map(x -> x); } catch (E e) { } return o instanceof Bar b ? 1 : 2; }\n}',
            [('java.access_modifiers', 'public,private', 0.9), ('java.annotations', 'GetMapping,Service', 0.95), ('java.async_reactive', 'none', 0.9), ('java.class_kind', 'class', 0.9), ('java.dependency_injection', 'none', 0.9), ('java.exception_handling', 'both', 0.9), ('java.functional_style', 'stream_lambda', 0.85), ('java.generic.present', 'yes', 0.9), ('java.modern_features', 'pattern_instanceof,var', 0.9), ('java.persistence_jpa', 'none', 0.9), ('java.rest_http_patterns', 'mapping,path_variable', 0.9), ('java.spring_stereotypes', 'service', 0.9), ('typing.channel', 'annotated', 0.65)],
        ),
        (
            'interface I {\n}',
            [('java.access_modifiers', 'package', 0.9), ('java.annotations', 'none', 0.95), ('java.async_reactive', 'none', 0.9), ('java.class_kind', 'interface', 0.9), ('java.dependency_injection', 'none', 0.9), ('java.exception_handling', 'none', 0.9), ('java.functional_style', 'none', 0.85), ('java.generic.present', 'no', 0.9), ('java.modern_features', 'none', 0.9), ('java.persistence_jpa', 'none', 0.9), ('java.rest_http_patterns', 'none', 0.9), ('java.spring_stereotypes', 'none', 0.9)],
        ),
        (
            '/**\n @Entity */\n// private\npublic @interface A {\n}\n@interface B {}\n@Table\n@Marked{n}\nclass e { String s = "new Mono<X>() -> throws E"; String t = """\n a "private" """; int f(int x) { return switch (x) { case 1, 2 -> 3; default -> 4; }; } boolean g(int a, int MAX) { return a < MAX; } }',
            [('java.access_modifiers', 'public', 0.9), ('java.annotations', 'Marked{n},Table', 0.95), ('java.async_reactive', 'none', 0.9), ('java.class_kind', 'interface', 0.9), ('java.dependency_injection', 'none', 0.9), ('java.exception_handling', 'none', 0.9), ('java.functional_style', 'none', 0.85), ('java.generic.present', 'no', 0.9), ('java.modern_features', 'switch_expression,text_block', 0.9), ('java.persistence_jpa', 'table', 0.9), ('java.rest_http_patterns', 'none', 0.9), ('java.spring_stereotypes', 'none', 0.9), ('typing.channel', 'annotated', 0.65)],
        ),
    ],
    'go': [
        (
            'package a\nfunc (s *T) F(ctx context.Context) error {\n ctx2 := context.WithTimeout(ctx, 1)\n go run()\n defer s.mu.Unlock()\n if err != nil { return err }\n for i := range 10 { }\n var m sync.RWMutex\n x.(T)\n}\nfunc init() {}\n',
            [('go.concurrency', 'goroutine', 0.9), ('go.context_usage', 'with_timeout', 0.9), ('go.defer_recover', 'defer', 0.9), ('go.error_handling', 'err_nil_check,error_return', 0.9), ('go.grpc_patterns', 'none', 0.9), ('go.http_patterns', 'none', 0.9), ('go.init_functions', 'yes', 0.85), ('go.interface_usage', 'type_assertion', 0.85), ('go.modern_features', 'range_over_int', 0.9), ('go.receiver_style', 'pointer', 0.9), ('go.struct_embedding', 'no', 0.85), ('go.sync_primitives', 'mutex', 0.9), ('typing.channel', 'annotated', 0.65)],
        ),
        (
            'package p\n',
            [('go.concurrency', 'none', 0.9), ('go.context_usage', 'none', 0.9), ('go.defer_recover', 'none', 0.9), ('go.error_handling', 'none', 0.9), ('go.grpc_patterns', 'none', 0.9), ('go.http_patterns', 'none', 0.9), ('go.init_functions', 'no', 0.85), ('go.interface_usage', 'none', 0.85), ('go.modern_features', 'none', 0.9), ('go.receiver_style', 'none', 0.9), ('go.struct_embedding', 'no', 0.85), ('go.sync_primitives', 'none', 0.9)],
        ),
        (
            '// go run()\nvar s = "select { defer panic("\nvar r = `recover()\nfunc init()`\ntype T struct {\n\tsync.Mutex\n\tn int\n}\nfunc (t T) F() {\n go t.run()\n x := y.(string)\n f := func(p *T) {}\n}\nfunc G(\n\tctx context.Context,\n) error { return\n err()\n}\n//go:embed a.txt\nvar e string\n',
            [('go.concurrency', 'goroutine', 0.9), ('go.context_usage', 'param', 0.9), ('go.defer_recover', 'none', 0.9), ('go.error_handling', 'none', 0.9), ('go.grpc_patterns', 'none', 0.9), ('go.http_patterns', 'none', 0.9), ('go.init_functions', 'no', 0.85), ('go.interface_usage', 'type_assertion', 0.85), ('go.modern_features', 'go_embed', 0.9), ('go.receiver_style', 'value', 0.9), ('go.struct_embedding', 'yes', 0.85), ('go.sync_primitives', 'mutex', 0.9), ('typing.channel', 'annotated', 0.65)],
        ),
    ],
    'javascript': [
        (
            "import x from 'y';\nconst app = express();\napp.use(cors());\napp.get('/a', async (req, res) => { await f(req.session); });\nclass Foo {}\nlet s = 'a' + 'b';\nconst c = new MongoClient();",
            [('javascript.async.present', 'yes', 0.95), ('javascript.auth_patterns', 'session_auth', 0.9), ('javascript.class_pattern', 'class', 0.9), ('javascript.database_client', 'mongodb_native', 0.9), ('javascript.http_framework', 'express', 0.9), ('javascript.middleware_patterns', 'cors', 0.9), ('javascript.module_system', 'esm', 0.95), ('javascript.plus_binding', 'str_concat', 0.9), ('javascript.realtime_messaging', 'none', 0.9), ('javascript.type_system', 'none', 0.85), ('typing.channel', 'annotated', 0.65)],
        ),
        (
            'let a = b;',
            [('javascript.async.present', 'no', 0.95), ('javascript.auth_patterns', 'none', 0.9), ('javascript.database_client', 'none', 0.9), ('javascript.http_framework', 'none', 0.9), ('javascript.middleware_patterns', 'none', 0.9), ('javascript.module_system', 'none', 0.95), ('javascript.realtime_messaging', 'none', 0.9), ('javascript.type_system', 'none', 0.85), ('typing.channel', 'annotated', 0.65)],
        ),
        (
            '// import x; class A {}\n/** @param {x} y */\nconst o = { a: b, c: d };\nconst t = `await ${x} require(\'y\')`;\nf(\'async function\', "it\'s", \'export default\');',
            [('javascript.async.present', 'no', 0.95), ('javascript.auth_patterns', 'none', 0.9), ('javascript.database_client', 'none', 0.9), ('javascript.http_framework', 'none', 0.9), ('javascript.middleware_patterns', 'none', 0.9), ('javascript.module_system', 'none', 0.95), ('javascript.realtime_messaging', 'none', 0.9), ('javascript.type_system', 'jsdoc', 0.85), ('typing.channel', 'annotated', 0.65)],
        ),
    ],
    'typescript': [
        (
            "@Controller('a')\nexport class A<T> {\n @Get() f(@Param() id: string): Observable<T> { return this.x.pipe(switchMap(y)) as any; }\n g(a: number) { return a + 1; }\n}",
            [('javascript.async.present', 'no', 0.95), ('javascript.auth_patterns', 'none', 0.9), ('javascript.class_pattern', 'class', 0.9), ('javascript.database_client', 'none', 0.9), ('javascript.decorators.present', 'Controller,Get', 0.95), ('javascript.http_framework', 'none', 0.9), ('javascript.middleware_patterns', 'none', 0.9), ('javascript.module_system', 'esm', 0.95), ('javascript.realtime_messaging', 'none', 0.9), ('javascript.type_system', 'typescript', 0.85), ('typescript.dependency_injection', 'none', 0.9), ('typescript.framework_decorators', 'controller', 0.9), ('typescript.generic.present', 'yes', 0.9), ('typescript.orm_persistence', 'none', 0.9), ('typescript.reactive_rxjs', 'observable,pipe,operators', 0.9), ('typescript.rest_http_patterns', 'http_method,param_decorator', 0.9), ('typescript.strict_mode', 'yes', 0.85), ('typing.channel', 'annotated', 0.65)],
        ),
        (
            'const c = d!.e;',
            [('javascript.async.present', 'no', 0.95), ('javascript.auth_patterns', 'none', 0.9), ('javascript.database_client', 'none', 0.9), ('javascript.http_framework', 'none', 0.9), ('javascript.middleware_patterns', 'none', 0.9), ('javascript.module_system', 'none', 0.95), ('javascript.realtime_messaging', 'none', 0.9), ('javascript.type_system', 'none', 0.85), ('typescript.dependency_injection', 'none', 0.9), ('typescript.framework_decorators', 'none', 0.9), ('typescript.generic.present', 'no', 0.9), ('typescript.orm_persistence', 'none', 0.9), ('typescript.reactive_rxjs', 'none', 0.9), ('typescript.rest_http_patterns', 'none', 0.9), ('typescript.strict_mode', 'yes', 0.85), ('typing.channel', 'annotated', 0.65)],
        ),
        (
            "import { a as b } from 'x';\nconst s = 'y as any';\n// z!.a\nif (a != b) { c(); }\nfunction f(x?: string) {}",
            [('javascript.async.present', 'no', 0.95), ('javascript.auth_patterns', 'none', 0.9), ('javascript.database_client', 'none', 0.9), ('javascript.http_framework', 'none', 0.9), ('javascript.middleware_patterns', 'none', 0.9), ('javascript.module_system', 'esm', 0.95), ('javascript.realtime_messaging', 'none', 0.9), ('javascript.type_system', 'typescript', 0.85), ('typescript.dependency_injection', 'none', 0.9), ('typescript.framework_decorators', 'none', 0.9), ('typescript.generic.present', 'no', 0.9), ('typescript.orm_persistence', 'none', 0.9), ('typescript.reactive_rxjs', 'none', 0.9), ('typescript.rest_http_patterns', 'none', 0.9), ('typescript.strict_mode', 'yes', 0.85), ('typing.channel', 'annotated', 0.65)],
        ),
    ],
    'python': [
        (
            "@dataclass\nclass A:\n    def __eq__(self, o: 'A') -> bool:\n        return True\nasync def f(a: int, b):\n    match a:\n        case 1: pass\n    return a + 1\n",
            [('python.async.present', 'yes', 0.95), ('python.class_style', 'dataclass', 0.9), ('python.decorators.present', 'dataclass', 0.95), ('python.dunder_methods.defined', '__eq__', 0.95), ('python.pattern_matching.present', 'yes', 0.95), ('python.plus_binding', 'numeric', 0.9), ('python.type_annotation.density', 'partial', 0.85), ('typing.channel', 'annotated', 0.65)],
        ),
        (
            'x = y\n',
            [('python.async.present', 'no', 0.95), ('python.pattern_matching.present', 'no', 0.95), ('python.type_annotation.density', 'none', 0.85)],
        ),
    ],
}
