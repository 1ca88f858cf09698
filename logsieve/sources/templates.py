"""Log texts, manifests and replies the test inputs are built from.

``{root}`` is the project root, ``{doc}`` a number of a source file that exists in it,
``{n}`` a line number and ``{k}`` a number from the event.
"""

TSC = """src/f{doc}.ts({n},5): error TS2322: Type 'string' is not assignable to type 'number'.
src/f{doc}.ts(2,1): error TS2322: Type 'undefined' is not assignable to type 'Item{k}'.
  src/f{doc}.ts(3,9): error TS2345: Argument of type 'string' is not assignable to parameter of type 'number'.
src/missing{k}.ts(1,20): error TS2307: Cannot find module './gone{k}' or its corresponding type declarations.
src/f{doc}.ts(7,3): error TS2339: Property 'size{k}' does not exist on type 'Box'.
src/f{doc}.ts(8,3): error TS2554: Expected 2 arguments, but got 1.
src/f{doc}.ts(9,3): error TS1005: ';' expected.

Found 7 errors in 2 files."""

TSC_ONE = "{root}/src/f{doc}.ts({n},1): error TS7006: Parameter 'x{k}' implicitly has an 'any' type.\nFound 1 error in 1 file."
TSC_GLOBALS = "src/f{doc}.ts(1,1): error TS2582: Cannot find name 'describe'. Do you need to install type definitions?\nsrc/../src/./f{doc}.ts(2,1): error TS2307: Cannot find module 'left-pad'."
TSC_NEAR = "src/f{doc}.ts(1,1): warning TS6133: 'x' is declared but never used.\nnothing else {k}"

ESLINT = """
{root}/src/f{doc}.ts
  {n}:12  error    'value' is not defined  no-undef
  5:1   error    Missing semicolon  semi
  6:1   warning  Unexpected console statement  no-console

/elsewhere/lib{k}.js
  1:1  error  Strings must use singlequote  @typescript-eslint/quotes

✖ 4 problems (3 errors, 1 warning)"""

ESLINT_WARN = """src/f{doc}.ts
  1:1  warning  First {k}  no-console
  2:1  warning  Second  no-console
  3:1  warning  Third  no-alert
  4:1  warning  Fourth  no-debugger
  5:1  warning  Fifth  prefer-const
  6:1  warning  Sixth  no-empty
  {n}:1  warning  Seventh  no-eval

✖ 7 problems (0 errors, 7 warnings)"""

ESLINT_ODD = """  9:9  error  Before any file  no-undef
checking the project now
  3:4  error  Filed under prose {k}  no-undef
src/f{doc}.ts:3:4 error unix form no-undef
1 problem (1 error, 0 warnings)"""

ESLINT_UNIX = "src/f{doc}.ts:{n}:4 error Unexpected var no-var"

NPM_404 = """npm error code E404
npm error 404 Not Found - GET https://registry.npmjs.org/no-such-pkg-{k} - Not found
npm error 404  'no-such-pkg-{k}@latest' is not in this registry."""
NPM_404_BARE = "npm ERR! code E404\nnpm ERR! something else {k}"
NPM_RESOLVE = """npm ERR! code ERESOLVE
npm ERR! ERESOLVE unable to resolve dependency tree
npm ERR! Could not resolve dependency:
npm ERR! peer react{k} "^17.0.0" from widget@1.0.0"""
NPM_RESOLVE_BARE = "npm ERR! code ERESOLVE\nnpm ERR! ERESOLVE could not resolve {k}"
NPM_ACCESS = "npm error code EACCES\nnpm error syscall mkdir {k}"
NPM_SCRIPT = "npm error code ENOENT\nnpm error Missing script: \"build{k}\""
NPM_ENTRY = "npm error code ENOENT\nnpm error enoent {root}/package{k}.json"
NPM_INTEGRITY = "npm error code EINTEGRITY\nnpm error sha512-{k} integrity checksum failed"
NPM_TARGET = "npm error code ETARGET\nnpm error notarget No matching version found for pkg{k}@9"
NPM_OTHER = "  npm   error code ELIFECYCLE\nnpm error\nnpm error errno {k}\nnpm error Exit status 1"
NPM_OTHER_EMPTY = "npm error code EUSAGE{k}"
NPM_NO_CODE = "npm ERR! network request failed {k}"

PY_ONE = """Traceback (most recent call last):
  File "{root}/src/f{doc}.ts", line {n}, in main
    run()
  File "lib/../tools/run.py", line {k}, in run
    value = data['k{k}']
KeyError: 'k{k}'"""
PY_TWO = """============ FAILURES ============
Traceback (most recent call last):
  File "src/f{doc}.ts", line 3, in test_a
ValueError: bad value {k}
Traceback (most recent call last):
  File "src/f{doc}.ts", line {n}, in test_b
    assert x
AttributeError: 'NoneType' object has no attribute 'size{k}'
FAILED tests/test_a.py::test_a - ValueError
FAILED tests/test_b.py::test_b[{k}] - AttributeError
FAILED tests/test_c.py::test_c - TypeError"""
PY_EMPTY_BLOCK = "Traceback (most recent call last):\n\nTraceback (most recent call last):\n  File \"a.py\", line 1\nFAILED t.py::t - OSError {k}"
PY_PIP = "FAILED x.py::y - KeyError\nERROR: No matching distribution found for pkg{k}\nERROR: second"
PY_SYNTAX = "run {k}\n  File \"src/f{doc}.ts\", line {n}\n    def f(:\n          ^\nSyntaxError: invalid syntax\nValueError: later"
PY_SYNTAX_FAR = "  File \"src/f{doc}.ts\", line {n}\n1\n2\n3\nIndentationError: unexpected indent {k}\nFAILED a.py::b - IndentationError"
PY_FAILED = "FAILED tests/test_x.py::TestX::test_one - AssertionError: {k}\nFAILED tests/test_x.py::test_two-KeyError"
PY_DOTTED = "Traceback (most recent call last):\n  File \"/usr/lib/x.py\", line {n}, in go\nrequests.exceptions.HTTPError: 500 {k}"
PY_MODULE = "Traceback (most recent call last):\n  File \"{root}/main.py\", line 1, in <module>\nModuleNotFoundError: No module named 'pkg{k}'"
PY_MODULE_ODD = "Traceback (most recent call last):\n  File \"main.py\", line 1\nImportError: No module named pkg{k}"
PY_KEY = "Traceback (most recent call last):\nRuntimeError: wrapped KeyError: 'inner{k}' here\n"
PY_CRLF = "Traceback (most recent call last):\r\n  File \"{root}/main.py\", line {n}, in f\r\nOSError: disk {k} full\r\n"

JAVA_TRACE = """Exception in thread "main" java.lang.NullPointerException: Cannot invoke "Foo.bar{k}()" because "f" is null
    at com.acme.Foo.run(Foo.java:{n})
    at com.acme.Main.main(src/Main.java:7)
    ... 3 more"""
JAVA_CAUSED = """java.lang.RuntimeException: top {k}
\tat com.acme.A.a(A.java:1)
Caused by: java.lang.IllegalStateException: middle
\tat com.acme.B.b({root}/src/f{doc}.ts.java:{n})
Caused by: java.lang.ClassCastException: root cause {k}
\tat com.acme.C.c(C.java:3)
 indented.Exception: not a header"""
JAVAC = "src/Main.java:{n}: error: cannot find symbol\n  symbol: x{k}\nsrc/B.java:2: error: ';' expected\njava.lang.Error: hidden by compile errors"
MAVEN = "[ERROR] {root}/src/A.java:[{n},5] incompatible types: String cannot be converted to int{k}\nException in thread \"x\" y.Error: z"
JAVA_MANY = """Exception in thread "main" java.lang.ArrayIndexOutOfBoundsException: Index {k} out of bounds for length 3
    at a.B.c(B.java:{n})
java.lang.StackOverflowError: deep
java.lang.ClassNotFoundException: com.acme.Gone{k}
java.lang.NullPointerException
    at a.B.d(B.java:2)"""
JAVA_NEAR = "    at com.acme.Foo.run(Foo.kt:{n})\nno java here {k}"

GO_COMPILE = "# example.com/app\n./main.go:{n}:5: undefined: foo{k}\npkg/util.go:3:1: cannot use x (type int) as string\npanic: hidden"
GO_PANIC = """panic: runtime error: index out of range [{k}] with length 3

goroutine 1 [running]:
main.process(0x1, 0x2)
\t{root}/src/f{doc}.ts.go:{n} +0x1d
\tpkg/again.go:9 +0x2a
main.(*Server).Run(...)
other text
main.main()
\tmain.go:7 +0x3b
exit status 2"""
GO_NIL = "panic: runtime error: invalid memory address or nil pointer dereference\ngoroutine {n} [running]:\nmain.main()\n\tmain.go:{n} +0xff"
GO_PANIC_ALONE = "panic: lonely {k}\nmain.go:{n} somewhere"
GO_TESTS = """--- FAIL: TestAB (0.0{k}s)
    ab_test.go:{n}: first message {k}
    ab_test.go:11: second message
=== RUN   TestA
    --- FAIL: TestAB/sub (0.00s)
--- FAIL: TestA (0.01s)
    a_test.go:5: own message
--- FAIL: TestQuiet (1.5s)
done
FAIL"""
GO_TEST_FAR = "--- FAIL: TestFar (0.00s)\n1\n2\n3\n4\n5\n6\n7\n8\n    in_test.go:{n}: ninth line\n    out_test.go:1: tenth line {k}"

RUST_COMPILE = """error[E0308]: mismatched types
 --> src/f{doc}.rs:{n}:14
  |
4 |     let x: i32 = "a{k}";
error[E0382]: borrow of moved value: `v{k}`
  |
  = note
  = note two
  --> src/four.rs:4:1
error[E0433]: failed to resolve: use of undeclared type `Foo{k}`
1
2
3
4
 --> src/five.rs:5:1
error: aborting due to 3 previous errors"""
RUST_ZERO = "error[E0502]: cannot borrow `x{k}` as mutable\n --> src/zero.rs:0:{n}"
RUST_OLD = "test tests::works_{k} ... FAILED\nthread 'main' panicked at 'index out of bounds: the len is 3', src/main.rs:{n}:5"
RUST_NEW = """running 1 test
test suite::adds ... FAILED
thread 'suite::adds' panicked at src/lib.rs:{n}:9:
assertion `left == right` failed
  left: {k}
 right: 4"""
RUST_BARE = "thread 'worker' panicked at src/w.rs:{n}:1:\nboom {k}"
RUST_NEAR = "error: could not compile `app{k}`"

VITEST = """ RUN  v1.6.0 {root}

 FAIL  src/math.test.ts > adds numbers {k}
AssertionError: expected 3 to equal 4
 ❯ src/math.test.ts:{n}:20
 ❯ helper {root}/src/f{doc}.ts:2:3

 FAIL  src/other.spec.ts > fails (12 ms)
TypeError: Cannot read properties of undefined (reading 'id{k}')
    at Object.load ({root}/src/f{doc}.ts:{n}:3)
    at {root}/node_modules/lib/index.js:1:1

 Tests  2 failed | 3 passed (5)"""
VITEST_SNAP = " RUN  v2.0.1\n FAIL  ui.test.tsx > view {k}\nError: Snapshot `view 1` mismatched\n ❯ ui.test.tsx:{n}:1\n Test Files  1 failed | 2 passed (3)\n Tests  1 failed | 0 passed (1)"

JEST = """FAIL src/cart.test.js
  ● cart › totals {k}

    ReferenceError: price is not defined

      at total (src/f{doc}.ts:{n}:5)
      at Object.<anonymous> (src/cart.test.js:3:1)

Test Suites: 1 failed, 1 total
Tests:       1 failed, 2 passed, 3 total"""
JEST_SHORT = "FAIL a.test.js (5.1 s)\nError: Timeout {k}\nTest Suites: 1 failed\nTests: {n} total"
JEST_PASSED = "PASS a.test.js {k}\nTest Suites: 1 passed, 1 total\nTests: {n} passed, {n} total"
JEST_TICKS = "Summary of tests {k}\n  ✕ adds two (3 ms)\n  × subtracts\n  ✗ long name here (40ms)\nTest Suites: 1 failed, 1 total"

ONE_FAIL = "FAIL only.test.ts (9 ms)\nsomething bad {k}\n    at run (src/f{doc}.ts:{n}:1)"
ONE_ERROR = "TypeError: lone {k} is not iterable\n    at run (src/f{doc}.ts:{n}:1)"
ONE_CROSS = "✕ lone cross {k}\n  details"
MANY_ERROR = "start {k}\nRangeError: Maximum call stack size exceeded\n    at walk (src/f{doc}.ts:{n}:1)\n    at walk (src/f{doc}.ts:4:1)\nError: second {k}\n    at {root}/src/f{doc}.ts:2:2"
MANY_CROSS = "header {k}\n✗ first\n✗ second.spec.ts (3 ms)\n"

NODE = """TypeError: cannot read property 'x' of null
    at load ({root}/src/f{doc}.ts:{n}:3)
    at sibling ({root}0/src/f{doc}.ts:2:3)
    at dep ({root}/node_modules/a/b.js:1:1)
    at node:internal/process/task_queues:95:5
    at async Promise.all (index 0)"""
NODE_FAR = "log {k}\n    at dep (/usr/lib/node_modules/a.js:{n}:1)\n    at other (/elsewhere/b.js:2:2)"
NODE_ZERO = "Error: zero frame {k}\n    at z (src/f{doc}.ts:0:0)\n    at q (src/f{doc}.ts:{n}:2)"

BUILD = "Build failed with 1 error:\nTransform failed: expected \";\" but found \"x{k}\"\n  File: src/f{doc}.ts:{n}:10\n"
BUILD_PACK = "webpack compiled\nModule not found: Error: Can't resolve './x{k}' in '{root}/src'\n"
BUILD_RAW = "Build failed\n./src/f{doc}.ts:{n}\nExpected ')' but found '}' {k}"
BUILD_NEAR = "test step\nBuild failed {k}"

ANSI = "\x1b[31mFAIL\x1b[0m  src/f{doc}.ts\n\x1b[1mTypeError\x1b[22m: colour{k} is not a function\n    at run (\x1b[36msrc/f{doc}.ts:{n}:1\x1b[39m)\n\x1b[2KError: after"
CRLF = "FAIL src/w.test.ts > windows {k} (3 ms)\r\nError: Network error at localhost:5432\r\n    at x (src/f{doc}.ts:{n}:1)\r\nTests: 1 failed, 1 total\r\n"
UNKNOWN = "The command ended early after {n} steps\nsee the log for details {k}"
BLANK = " \n\t\n"
EMPTY = ""

SAME_PREFIX = "\n".join(
    ["start {k}"]
    + [
        f"TypeError: the very same long message prefix that goes on for ever is not a function {i}"
        for i in range(6)
    ]
)
MIXED = """start
Error: Timeout of 5000ms exceeded {k}
Error: ECONNREFUSED 127.0.0.1:6379
Error: EACCES: permission denied, open '/x'
Error: duplicate key value violates unique constraint "u{k}"
Error: JavaScript heap out of memory
Error: expected true to be false
Error: missing environment variable API_{k}
Error: Unhandled promise rejection"""
UNHANDLED = "Unhandled Rejection {k}\nError: something odd\n    at f ({root}/src/f{doc}.ts:{n}:1)"

LIBRARY = "FAIL src/db.spec.ts > db {k}\nPrismaClientError: prisma failed at {root}/src/f{doc}.ts:{n}   badly\n    at query (src/f{doc}.ts:{n}:2)\nran with mocha then jest"
LONG = "Error: " + "word " * 40 + "end {k}\n    at longFunction (src/f{doc}.ts:{n}:2)"
UNICODE = "Error: größer als {k} — naïve café\n    at läuft (src/f{doc}.ts:{n}:2)"

# One message per rule that the texts above do not reach, each behind an error type.
RULE_MESSAGES = [
    "TypeError: Cannot read properties of undefined (reading 'name')",
    "TypeError: Cannot read property of null",
    "TypeError: Thing{k} is not a constructor",
    "Error: Cannot find module 'express{k}'",
    "Error: ERR_MODULE_NOT_FOUND {k}",
    "Error: require() of ES Module /a/b{k}.js not supported",
    "Error [ERR_REQUIRE_ESM]: gone",
    "SyntaxError: Cannot use import statement outside a module",
    "TypeError: lib_1.default is not a function",
    "SyntaxError: Unexpected token '<'",
    "TypeError: Assignment to constant variable.",
    "ReferenceError: foo{k} is not defined",
    "Error: async callback was not invoked within limit",
    "Error: connect ECONNREFUSED 0.0.0.0:27017",
    "Error: getaddrinfo ENOTFOUND api{k}.example.com:80",
    "Error: relation \"users{k}\" does not exist",
    "Error: env var TOKEN{k} not set",
    "Error: process.env.KEY{k} is required",
    "Error: fatal: heap limit {k}",
    "AssertionError [ERR_ASSERTION]: expected 1 but got {k}",
    "Error: expect(value).toEqual(other) {k}",
    "Error: assertion of {k} failed",
    "Error: toMatchSnapshot differs {k}",
    "ReferenceError: beforeEach is not defined",
    "Error: object has no property 'z{k}'",
    "Error: expected an array of {k}",
    "Error: cannot safely iterate {k}",
    "Error: index {k} is out of all bounds",
    "Error: value{k} is undefined",
    "Error: undefined is certainly not an object {k}",
    "Error: nothing known about this {k}",
    "Error: Property 'a' does not exist here and unknown database {k}",
]

TEMPLATES = [
    ("tsc --noEmit", TSC), ("tsc --noEmit", TSC_ONE), ("tsc", TSC_GLOBALS), ("tsc", TSC_NEAR),
    ("eslint .", ESLINT), ("eslint .", ESLINT_WARN), ("eslint .", ESLINT_ODD),
    ("eslint -f unix .", ESLINT_UNIX),
    ("npm install", NPM_404), ("npm install", NPM_404_BARE), ("npm install", NPM_RESOLVE),
    ("npm install", NPM_RESOLVE_BARE), ("npm install", NPM_ACCESS), ("npm run x", NPM_SCRIPT),
    ("npm ci", NPM_ENTRY), ("npm ci", NPM_INTEGRITY), ("npm ci", NPM_TARGET),
    ("npm test", NPM_OTHER), ("npm test", NPM_OTHER_EMPTY), ("npm test", NPM_NO_CODE),
    ("python main.py", PY_ONE), ("pytest", PY_TWO), ("pytest", PY_EMPTY_BLOCK),
    ("pip install", PY_PIP), ("python x.py", PY_SYNTAX), ("pytest", PY_SYNTAX_FAR),
    ("pytest", PY_FAILED), ("python x.py", PY_DOTTED), ("python x.py", PY_MODULE),
    ("python x.py", PY_MODULE_ODD), ("python x.py", PY_KEY), ("python x.py", PY_CRLF),
    ("java Main", JAVA_TRACE), ("java Main", JAVA_CAUSED), ("javac", JAVAC), ("mvn", MAVEN),
    ("java Main", JAVA_MANY), ("kotlin", JAVA_NEAR),
    ("go build", GO_COMPILE), ("go run", GO_PANIC), ("go run", GO_NIL),
    ("go run", GO_PANIC_ALONE), ("go test", GO_TESTS), ("go test", GO_TEST_FAR),
    ("cargo build", RUST_COMPILE), ("cargo build", RUST_ZERO), ("cargo run", RUST_OLD),
    ("cargo test", RUST_NEW), ("cargo run", RUST_BARE), ("cargo build", RUST_NEAR),
    ("vitest run", VITEST), ("vitest run", VITEST_SNAP),
    ("jest", JEST), ("jest", JEST_SHORT), ("jest", JEST_PASSED), ("jest", JEST_TICKS),
    ("make test", ONE_FAIL), ("make test", ONE_ERROR), ("make test", ONE_CROSS),
    ("make test", MANY_ERROR), ("make test", MANY_CROSS),
    ("node app.js", NODE), ("node app.js", NODE_FAR), ("node app.js", NODE_ZERO),
    ("vite build", BUILD), ("webpack", BUILD_PACK), ("build", BUILD_RAW), ("build", BUILD_NEAR),
    ("make test", ANSI), ("make test", CRLF), ("make", UNKNOWN), ("make", BLANK), ("true", EMPTY),
    ("make test", SAME_PREFIX), ("make test", MIXED), ("node app.js", UNHANDLED),
    ("mocha", LIBRARY), ("node app.js", LONG), ("node app.js", UNICODE),
] + [
    ("node app.js", f"{message}\n    at call (src/f{{doc}}.ts:{{n}}:7)\n    at {{root}}/src/f{{doc}}.ts:3:1")
    for message in RULE_MESSAGES
]

STEPS = [
    "run_tests", "parse_failures", "collect_context", "git_context", "generate_queries",
    "tavily_search", "summarize_external", "infer_root_causes", "assemble_packet",
    "llm_enhance", "render_report", "write_artifacts",
]

MANIFESTS = [
    '{"name": "{name}", "description": "{segment} app", "type": "module", "dependencies": {"react": "1", "zod-{key}": "2"}, "devDependencies": {"vitest": "1", "jest": "2"}, "scripts": {"build": "tsc -p {key}", "test": "vitest"}, "engines": {"node": ">=18"}}',
    '{"name": "{name}", "dependencies": {"express": "4"}, "devDependencies": {"mocha": "9", "ava": "3"}, "scripts": {"start": "node ."}}',
    '{"description": "no name {key}", "devDependencies": {"jest": "29"}}',
    '{"name": "{name}", "scripts": {"a": "1", "b": "2", "c": "3", "d": "4", "e": "5", "f": "6", "g": "7", "h": "8", "i": "9", "j": "10", "k": "11"}}',
    '{broken {key}',
    '{"name": "odd {key}", "engines": ">=18", "dependencies": {"x": "1"}, "devDependencies": {"vitest": "1"}, "scripts": "none"}',
    '{"name": "trailing {key}", "dependencies": {"x": "1"}} // done',
    "{'name': 'quoted {key}'}",
]

# (modulus, remainder, path, content): the file exists where key % modulus = remainder.
PROJECT_FILES = [
    (2, 0, "tsconfig.json", '{"compilerOptions": {"strict": true, "target": "ES2022", "module": "NodeNext", "paths": {"@/*": ["src/*"]}}}'),
    (6, 3, "tsconfig.json", '{"compilerOptions": {"strict": false, "noUncheckedIndexedAccess": true}}'),
    (6, 5, "tsconfig.json", '{"extends": "./base.json"}'),
    (12, 1, "tsconfig.json", '{"compilerOptions": {"strict": "false", "noUncheckedIndexedAccess": 0, "target": "ES5"}}'),
    (12, 7, "tsconfig.json", '{"compilerOptions": {"strict": true}} // comment'),
    (4, 1, "src/auth/index.ts", "auth"),
    (4, 1, "src/auth-client/main.ts", "client"),
    (4, 1, "src/App.ts", "capital"),
    (4, 1, "src/api.ts", "small"),
    (3, 0, ".env.example", "# settings\nAPI_KEY=abc{key}\n  DB_URL=postgres://x=y\nNOVALUE\n=empty\n\nMODE={segment}"),
    (4, 1, "README.md", "# {name}\n" + "A project of the {segment} segment. " * 20),
    (4, 2, "readme.md", "lower case readme {key}"),
    (8, 1, "readme.md", "shadowed readme"),
    (4, 3, "src/index.ts", "export const key = {key};"),
    (8, 3, "src/lib/index.ts", "export {};"),
    (3, 1, "src/app.ts", "app"),
    (5, 2, "src/cli.ts", "cli"),
    (7, 0, "src/main.js", "main"),
    (6, 1, "src/lib/util.test.ts", "test"),
    (6, 2, "src/lib/deep/server.tsx", "server"),
    (4, 0, "src/a/b/c/d/e/too-deep.ts", "deep"),
    (3, 2, "src/node_modules/x/index.js", "dep"),
    (3, 0, "src/.hidden/x.ts", "hidden"),
    (5, 0, "src/dist/out.js", "out"),
    (5, 1, "src/coverage/report.txt", "cov"),
    (6, 1, "index.js", "root index"),
    (9, 4, "app.js", "root app"),
    (2, 1, "docs/guide.md", "guide"),
]

REPLIES = [
    '{"rootCauseNarrative": "The value of f{doc} is null", "codeFix": "x ?? 0", "fixFile": "src/f{doc}.ts", "fixExplanation": "guards", "fixAlternatives": ["one", "two"], "externalSynthesis": "known"}',
    '```json\n{"rootCauseNarrative": "Fenced {doc}", "fixAlternatives": [], "externalSynthesis": null}\n```',
    '  {"codeFix": "only a fix"}  ',
    'Sorry, I cannot answer {doc}.',
    '```\n{"fixFile": "a{doc}.ts", "fixAlternatives": ["single"]}\n```',
    '{"rootCauseNarrative": "cut off {doc}',
    '',
    '[1]',
    '{"codeFix": "f{doc}", "fixAlternatives": "one"}',
    '{"codeFix": "f{doc}"} and more',
    "{'codeFix': 'f{doc}'}",
]
