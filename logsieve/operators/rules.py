"""The ordered root-cause rules as data.

A rule is a predicate, a category, a confidence and three texts. Predicates are an OR of ANDs
of ``(field, pattern)`` tests; ``m`` is the message, ``t`` the error type, ``raw`` the raw
output; a leading ``!`` negates and ``line`` asks whether the first project line is known.
Any other field name is a value captured by the text it belongs to. A text is one template or
a list of ``(condition, template)`` tried in order. Templates name ``{m}`` message, ``{loc}``
file and line, ``{file}``, ``{line}``, ``{test}`` and captured values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

Test = list[list[tuple[str, str]]]


@dataclass(frozen=True)
class Text:
    """A template with its captures: name -> (pattern, group, fallback template)."""

    template: object
    captures: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    rank: int
    category: str
    confidence: str
    test: Test
    explain: Text
    fix: Text
    evidence: str = "m"


# Categories and the order of confidence.
CATEGORIES = [
    "undefined_or_null", "type_mismatch", "assertion_failure", "missing_property",
    "import_or_module", "async_or_promise", "timeout", "network_or_io", "shape_mismatch",
    "index_out_of_bounds", "syntax_error", "infinite_recursion", "module_interop",
    "permission_error", "database_error", "test_setup_error", "environment_error",
    "compilation_error", "dependency_conflict", "lint_error", "resource_limit", "unknown",
]
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}
MAX_HYPOTHESES = 5
KEY_LENGTH = 50
UNKNOWN_RANK = 99

# Well-known database ports.
PORTS = {"5432": "PostgreSQL", "3306": "MySQL", "27017": "MongoDB", "6379": "Redis"}


def m(*patterns: str) -> Test:
    return [[("m", p)] for p in patterns]


READING = r"(?i)reading '([^']+)'"
FUNCTION = r"(?i)(\S+) is not a function"
CONSTRUCTOR = r"(?i)(\S+) is not a constructor"
MODULE = r"(?i)cannot find module '([^']+)'"
NOT_DEFINED = r"(?i)(\w+) is not defined"
NO_SCHEMA = r"(?i)no.such.table|does not exist|unknown database"
ASSIGNABLE = r"(?i)Type '([^']+)' is not assignable to type '([^']+)'"
PROPERTY_TYPE = r"(?i)Property '([^']+)' does not exist on type '([^']+)'"
PY_MODULE = r"(?i)No module named '([^']+)'"
KEY_ERROR = r"(?i)KeyError:\s*'?([^']*)'?"
ATTRIBUTE = r"(?i)'(\w+)' object has no attribute '(\w+)'"

# The rules in their order, with the patterns and texts they stand for.
RULES = [
    Rule(1, "undefined_or_null", "high",
         m(r"(?i)cannot read propert(?:y|ies) of (?:undefined|null)"),
         Text("Attempted to access '.{prop}' on {val} at {loc}. The variable is {val} when it should be initialized.",
              {"val": (r"(?i)of (\w+)", 1, "a value"), "prop": (READING, 1, "a property")}),
         Text("Add a null/undefined check before accessing '.{prop}' at {loc}, or ensure the value is properly initialized upstream.",
              {"prop": (READING, 1, "the property")}),
         "loc"),
    Rule(2, "type_mismatch", "high", m(r"(?i)is not a function"),
         Text("'{name}' was called as a function but is not callable. This often indicates a wrong import, misspelled method name, or a variable that was overwritten.",
              {"name": (FUNCTION, 1, "The value")}),
         Text("Verify that '{name}' is correctly imported/defined and is a function. Check for typos, default export mismatches, and variable shadowing.",
              {"name": (FUNCTION, 1, "the identifier")})),
    Rule(3, "type_mismatch", "high", m(r"(?i)is not a constructor"),
         Text("'{name}' was used with 'new' but is not a constructor. Check that the import is a class or constructor function, not a plain object or default export wrapper.",
              {"name": (CONSTRUCTOR, 1, "The value")}),
         Text("Check the import of '{name}'. For CommonJS/ESM interop, try 'import { {name} }' instead of 'import {name}', or access '.default'.",
              {"name": (CONSTRUCTOR, 1, "the identifier")})),
    Rule(4, "type_mismatch", "high", m(r"(?i)is not iterable"),
         Text("'{name}' was used in a for...of loop or spread/destructuring but is not iterable. The value may be undefined, null, or a non-iterable type.",
              {"name": (r"(?i)(\S+) is not iterable", 1, "The value")}),
         Text("Ensure the value is an array or iterable before iterating. Add a null check or default to an empty array (e.g., 'items ?? []').")),
    Rule(5, "import_or_module", "high", m(r"(?i)cannot find module", r"(?i)err_module_not_found"),
         Text("Module '{mod}' could not be resolved. This could be a missing dependency, incorrect path, or misconfigured module resolution.",
              {"mod": (MODULE, 1, "the module")}),
         Text([([[("mod", r"^[./]")]], "Check that the file path '{mod}' is correct and the file exists. Verify file extensions and case sensitivity."),
               (None, "Run 'npm install {mod}' or verify the package name is correct in your dependencies.")],
              {"mod": (MODULE, 1, "")})),
    Rule(6, "module_interop", "high", m(r"(?i)err_require_esm", r"(?i)require\(\) of es module"),
         Text("Attempted to require() an ES module ({mod}). The package is ESM-only and must be imported with 'import', not 'require()'.",
              {"mod": (r"(?i)require\(\) of ES Module ([^\r\n]+?)(?:\s|\z)", 1, "the module")}),
         Text("Use dynamic 'import()' instead of 'require()', or add \"type\": \"module\" to your package.json and switch to import statements.")),
    Rule(7, "module_interop", "high", m(r"(?i)cannot use import statement outside a module"),
         Text("The file uses ES module 'import' syntax but is being loaded as CommonJS. This typically means the project is missing \"type\": \"module\" in package.json, or the file extension should be .mjs."),
         Text("Add \"type\": \"module\" to package.json, or rename the file to .mjs, or use require() instead of import.")),
    Rule(8, "module_interop", "high", m(r"(?i)\.default is not a function"),
         Text("'{name}.default' is not a function. This is a common ESM/CJS interop issue where a default export is accessed incorrectly.",
              {"name": (r"(?i)(\S+)\.default is not a function", 1, "The import")}),
         Text("Try using the import directly without '.default', or switch between 'import X from' and 'import { default as X } from'. Check if the package uses module.exports vs export default.")),
    Rule(9, "syntax_error", "high",
         [[("t", r"^SyntaxError\z")], [("m", r"(?i)unexpected token")],
          [("m", r"(?i)transform failed|expected[^\r\n]*but found")],
          [("raw", r"(?i)expected[^\r\n]*but found")]],
         Text("Syntax error: {m}. The code has a structural issue preventing parsing."),
         Text([([[("line", "")]], "Check {file} near line {line} for syntax issues: missing brackets, semicolons, or invalid expressions."),
               (None, "Check the indicated file for syntax issues: missing brackets, semicolons, or invalid expressions.")]),
         "file"),
    Rule(10, "infinite_recursion", "high", m(r"(?i)maximum call stack size exceeded"),
         Text("Maximum call stack size exceeded — infinite recursion detected. A function is calling itself (directly or indirectly) without a proper base case."),
         Text("Check {file} for recursive function calls. Add or fix the base case that stops recursion. Look for circular dependencies between modules."),
         "frames"),
    Rule(11, "type_mismatch", "high", m(r"(?i)assignment to constant variable"),
         Text("Attempted to reassign a variable declared with 'const'. Use 'let' instead if the value needs to change."),
         Text("Change 'const' to 'let' at the declaration site, or restructure the code to avoid reassignment. Location: {loc}."),
         "loc"),
    Rule(12, "missing_property", "high",
         [[("t", r"^ReferenceError\z")], [("m", r"(?i)ReferenceError[^\r\n]*is not defined")]],
         Text("'{name}' is not defined in the current scope. It may be misspelled, not imported, or declared in a different scope.",
              {"name": (NOT_DEFINED, 1, "A variable")}),
         Text("Import or declare '{name}' before use. Check for typos in the variable name. Location: {loc}.",
              {"name": (NOT_DEFINED, 1, "the variable")}),
         "loc"),
    Rule(13, "timeout", "high",
         m(r"(?i)timeout", r"(?i)exceeded[^\r\n]*time", r"(?i)async callback was not invoked"),
         Text("Operation timed out: {m}. An async operation or test took longer than the allowed time limit."),
         Text("Increase the timeout threshold, or investigate why the operation is slow. Check for missing 'await', unresolved promises, or blocking operations.")),
    Rule(14, "network_or_io", "high",
         m(r"(?i)econnrefused|enotfound|econnreset|econnaborted|epipe|fetch failed|network error"),
         Text([([[("port", r"^(?:5432|3306|27017|6379)\z")]], "Network error: {m}. A connection to an external service failed ({service} on port {port})."),
               (None, "Network error: {m}. A connection to an external service failed.")],
              {"port": (r"(?i)(?:localhost|127\.0\.0\.1|0\.0\.0\.0):(\d+)", 1, "")}),
         Text("Verify the target service is running and accessible. Check the URL/host/port configuration. Consider mocking the service in tests.")),
    Rule(15, "permission_error", "high", m(r"(?i)eperm|eacces|permission denied"),
         Text("Permission denied: {m}. The process lacks the necessary filesystem or OS permissions."),
         Text("Check file/directory permissions. On macOS/Linux: 'chmod' or 'chown'. In CI: ensure the build user has access. Avoid writing to read-only directories.")),
    Rule(16, "database_error", "high",
         m(r"(?i)er_no_such_table|relation[^\r\n]*does not exist|no such table|unknown database",
           r"(?i)unique constraint|duplicate key|violates[^\r\n]*constraint"),
         Text([([[("m", NO_SCHEMA)]], "Database schema error: {m}. The table or database doesn't exist — likely a missing migration."),
               (None, "Database constraint violation: {m}. A unique or foreign key constraint was violated.")]),
         Text([([[("m", NO_SCHEMA)]], "Run pending database migrations (e.g., 'npx prisma migrate dev', 'npx knex migrate:latest'). Ensure the test database is set up."),
               (None, "Check for duplicate data in test fixtures or seed data. Ensure unique fields have unique values across test cases.")])),
    Rule(17, "environment_error", "medium",
         m(r"(?i)env[^\r\n]*not[^\r\n]*(?:set|defined|found)|missing[^\r\n]*(?:env|environment|variable)",
           r"(?i)process\.env\.\w+[^\r\n]*(?:undefined|required)"),
         Text("Environment configuration error: {m}. A required environment variable is missing or misconfigured."),
         Text("Set the required environment variable in your .env file or CI configuration. Check .env.example for the expected variables.")),
    Rule(18, "compilation_error", "high", m(r"(?i)TS2322:[^\r\n]*not assignable"),
         Text("TypeScript type mismatch: '{from}' is not assignable to '{to}'. The value's type doesn't match what the variable/parameter expects.",
              {"from": (ASSIGNABLE, 1, "the provided type"), "to": (ASSIGNABLE, 2, "the expected type")}),
         Text([([[("from", r"^(?:undefined|null)\z")]], "Add a null check or use the non-null assertion operator. The value might be {from} but the target type '{to}' doesn't allow it."),
               (None, "Fix the type mismatch at {loc}. Either change the value to match type '{to}', or update the type definition to accept '{from}'.")],
              {"from": (ASSIGNABLE, 1, ""), "to": (ASSIGNABLE, 2, "")}),
         "loc"),
    Rule(19, "compilation_error", "high", m(r"(?i)TS2345:[^\r\n]*not assignable to parameter"),
         Text("TypeScript argument type mismatch: {m}. The argument passed to a function doesn't match the expected parameter type."),
         Text("Fix the argument type at {loc}. Check the function signature and pass a value of the correct type."),
         "loc"),
    Rule(20, "import_or_module", "high", m(r"(?i)TS2307:[^\r\n]*cannot find module"),
         Text("TypeScript can't find module '{mod}'. The import path may be wrong, the package may not be installed, or type declarations may be missing.",
              {"mod": (MODULE, 1, "the module")}),
         Text([([[("mod", r"^\.")]], "Check the import path '{mod}' — the file may not exist or the extension may be wrong."),
               (None, "Run 'npm install {mod}' or 'npm install @types/{mod}' if it's a type declaration.")],
              {"mod": (MODULE, 1, "")}),
         "loc"),
    Rule(21, "missing_property", "high", m(r"(?i)TS2339:[^\r\n]*does not exist on type"),
         Text("Property '{prop}' doesn't exist on type '{type}'. The property may be misspelled, or the type definition needs updating.",
              {"prop": (PROPERTY_TYPE, 1, "the property"), "type": (PROPERTY_TYPE, 2, "the type")}),
         Text("Add '{prop}' to the '{type}' interface, fix the typo, or use a type assertion if you're sure it exists.",
              {"prop": (PROPERTY_TYPE, 1, "the property"), "type": (PROPERTY_TYPE, 2, "the type")}),
         "loc"),
    Rule(22, "compilation_error", "high",
         m(r"(?i)TS2554:[^\r\n]*Expected \d+ arguments?, but got \d+"),
         Text("Wrong number of arguments: {m}. The function call has too many or too few arguments."),
         Text("Check the function signature at {loc} and pass the correct number of arguments. Some may need to be optional."),
         "loc"),
    Rule(23, "compilation_error", "medium",
         [[("m", r"TS\d+:"), ("!m", r"TS2322|TS2345|TS2307|TS2339|TS2554")]],
         Text("TypeScript error {code}: {rest}",
              {"code": (r"(?i)(TS\d+):\s*([^\r\n]+)", 1, ""), "rest": (r"(?i)(TS\d+):\s*([^\r\n]+)", 2, "{m}")}),
         Text("Fix the TypeScript error at {loc}. Check the TypeScript documentation for this error code."),
         "loc"),
    Rule(24, "dependency_conflict", "high",
         m(r"(?i)E404:[^\r\n]*not found|package[^\r\n]*not found"),
         Text("npm package not found: {m}. The package name may be misspelled or it may have been unpublished."),
         Text("Check the package name for typos. Search https://www.npmjs.com/ to verify the correct name.")),
    Rule(25, "dependency_conflict", "high",
         m(r"(?i)ERESOLVE|peer dependency conflict|unable to resolve dependency"),
         Text("npm dependency conflict: {m}. Packages require incompatible versions of a shared dependency."),
         Text("Try 'npm install --legacy-peer-deps' to bypass the conflict, or update the conflicting packages to compatible versions.")),
    Rule(26, "compilation_error", "high",
         [[("t", r"^CompilerError\z"),
           ("m", r"(?i)incompatible types|cannot be converted|cannot find symbol")]],
         Text("Compiler error: {m}"),
         Text("Fix the compiler error at {loc}. Check types, imports, and variable declarations."),
         "loc"),
    Rule(27, "lint_error", "high", [[("t", r"^ESLintError\z")]],
         Text([([[("m", r"auto-fixable")]], "ESLint error (auto-fixable): {m}. Run 'eslint --fix' to resolve automatically."),
               (None, "ESLint error: {m}. This requires a manual code change.")]),
         Text([([[("m", r"auto-fixable")]], "Run 'eslint --fix' to auto-fix this issue, then re-run the linter to verify."),
               (None, "Fix the lint error at {loc}. Review the ESLint rule documentation for guidance.")]),
         "loc"),
    Rule(28, "resource_limit", "high",
         m(r"(?i)out of memory|heap|allocation failed|javascript heap"),
         Text("Node.js ran out of memory. The process exceeded the default heap size limit."),
         Text("Increase memory: NODE_OPTIONS=--max-old-space-size=4096. Or investigate memory leaks / large data processing.")),
    Rule(29, "import_or_module", "high", m(r"(?i)ModuleNotFoundError|No module named"),
         Text("Python module '{mod}' not found. It may need to be installed or the import path is wrong.",
              {"mod": (PY_MODULE, 1, "unknown")}),
         Text([([[("mod", r"[\s\S]")]], "Run: pip install {mod}"),
               (None, "Install the missing Python package with pip.")],
              {"mod": (PY_MODULE, 1, "")})),
    Rule(30, "syntax_error", "high",
         [[("m", r"(?i)IndentationError")], [("t", r"^IndentationError\z")]],
         Text("Python indentation error: {m}. Python requires consistent indentation (spaces or tabs, not mixed)."),
         Text("Fix the indentation — use consistent spaces (4 per level is standard). Don't mix tabs and spaces."),
         "loc"),
    Rule(31, "missing_property", "high", [[("m", r"(?i)KeyError")], [("t", r"^KeyError\z")]],
         Text("Python KeyError: key '{key}' not found in dictionary.", {"key": (KEY_ERROR, 1, "unknown")}),
         Text("Check if '{key}' exists before accessing: use dict.get('{key}', default) or 'if \"{key}\" in dict'.",
              {"key": (KEY_ERROR, 1, "the key")})),
    Rule(32, "missing_property", "high",
         [[("m", r"(?i)AttributeError")], [("t", r"^AttributeError\z")]],
         Text([([[("m", ATTRIBUTE)]], "Python AttributeError: '{object}' object has no attribute '{name}'."),
               (None, "Python AttributeError: {m}")],
              {"object": (ATTRIBUTE, 1, ""), "name": (ATTRIBUTE, 2, "")}),
         Text("Check the object type and verify the attribute name. The object may be the wrong type or the attribute is misspelled.")),
    Rule(33, "undefined_or_null", "high", m(r"(?i)nil pointer dereference|invalid memory address"),
         Text("Go nil pointer dereference: attempted to use a nil pointer. A variable was not initialized or a function returned nil."),
         Text("Add a nil check before using the pointer at {loc}. Check the function that returns this value."),
         "loc"),
    Rule(34, "index_out_of_bounds", "high",
         [[("m", r"(?i)index out of range"), ("t", r"^panic\z")]],
         Text("Go panic: {m}. A slice or array was accessed beyond its length."),
         Text("Add bounds checking before accessing the slice/array. Use len() to verify the index is within range.")),
    Rule(35, "missing_property", "high",
         [[("m", r"(?i)^undefined:"), ("t", r"^CompilerError\z")]],
         Text("Go compiler error: {m}. The variable or function is not defined in the current scope."),
         Text("Declare the variable before use, or import the package that defines it.")),
    Rule(36, "type_mismatch", "high", m(r"(?i)E0308[^\r\n]*mismatched types"),
         Text("Rust type mismatch: {m}. The expected and actual types don't match."),
         Text("Fix the type mismatch — either change the value to match the expected type, or update the function signature."),
         "loc"),
    Rule(37, "type_mismatch", "high",
         m(r"(?i)E0382[^\r\n]*moved value|E0502[^\r\n]*cannot borrow|E0505[^\r\n]*borrowed value"),
         Text("Rust ownership/borrowing error: {m}. The borrow checker prevents use-after-move or conflicting borrows."),
         Text("Use .clone() to avoid moving, or restructure code to satisfy the borrow checker. Consider using references (&) instead of owned values."),
         "loc"),
    Rule(38, "import_or_module", "high",
         m(r"(?i)E0433[^\r\n]*failed to resolve|E0425[^\r\n]*cannot find value"),
         Text("Rust module/value not found: {m}"),
         Text("Add the missing 'use' statement, or add the crate to Cargo.toml dependencies.")),
    Rule(39, "undefined_or_null", "high",
         [[("t", r"(?i)NullPointerException")], [("m", r"(?i)NullPointerException")]],
         Text("Java NullPointerException: {m}. A null reference was dereferenced."),
         Text("Add a null check at {loc} before using the object. Use Optional<T> for values that may be absent."),
         "loc"),
    Rule(40, "import_or_module", "high",
         [[("t", r"(?i)ClassNotFoundException|NoClassDefFoundError")]],
         Text("Java class not found: {m}. The class is not on the classpath."),
         Text("Add the missing dependency to pom.xml (Maven) or build.gradle (Gradle), then rebuild.")),
    Rule(41, "index_out_of_bounds", "high", [[("t", r"(?i)ArrayIndexOutOfBoundsException")]],
         Text("Java ArrayIndexOutOfBoundsException: {m}. An array was accessed beyond its length."),
         Text("Add bounds checking: verify index < array.length before access.")),
    Rule(42, "type_mismatch", "high", [[("t", r"(?i)ClassCastException")]],
         Text("Java ClassCastException: {m}. An object was cast to an incompatible type."),
         Text("Check the actual type with instanceof before casting, or use generics to avoid casts.")),
    Rule(43, "infinite_recursion", "high", [[("t", r"(?i)StackOverflowError")]],
         Text("Java StackOverflowError: infinite recursion or deeply nested calls exceeded the stack limit."),
         Text("Check for recursive method calls without a proper base case. Consider converting recursion to iteration.")),
    Rule(44, "assertion_failure", "medium",
         m(r"(?i)expected[^\r\n]*received|expected[^\r\n]*but got|to equal|to be|toEqual|toBe",
           r"(?i)expected[^\r\n]*to[^\r\n]*(?:equal|be|match|contain)",
           r"(?i)assertion[^\r\n]*failed|assert[^\r\n]*failed"),
         Text("Test assertion failed: the actual value did not match the expected value. {m}"),
         Text("Review the test '{test}' and the code it exercises. Either the expected value in the test is wrong, or the code under test has a bug."),
         "test"),
    Rule(45, "assertion_failure", "medium", m(r"(?i)snapshot"),
         Text("Snapshot test failed. The component or function output has changed since the last snapshot was saved."),
         Text("If the change is intentional, update the snapshot with '--update' flag (e.g., 'npx vitest run --update'). Otherwise, investigate what caused the output to change."),
         "test"),
    Rule(46, "async_or_promise", "medium",
         [[("m", r"(?i)unhandled[^\r\n]*promise|unhandled[^\r\n]*rejection")],
          [("raw", r"(?i)unhandled[^\r\n]*rejection|unhandled[^\r\n]*error")]],
         Text("An unhandled promise rejection occurred. A promise was rejected but had no .catch() handler or try/catch around its await."),
         Text("Add error handling: wrap 'await' calls in try/catch, or add .catch() to promise chains. Ensure test setup/teardown handles async cleanup.")),
    Rule(47, "test_setup_error", "medium",
         m(r"(?i)beforeeach is not defined|aftereach is not defined|beforeall[^\r\n]*not[^\r\n]*defined",
           r"(?i)cannot find name 'describe'|cannot find name 'it'|cannot find name 'test'"),
         Text("Test framework globals are not available. The test runner is not configured correctly, or type definitions are missing."),
         Text("Ensure vitest/jest types are installed. Add \"types\": [\"vitest/globals\"] to tsconfig.json, or import { describe, it, expect } from your test framework.")),
    Rule(48, "missing_property", "medium",
         m(r"(?i)has no property|property[^\r\n]*does not exist|no such property"),
         Text("A property that was expected to exist is missing: {m}"),
         Text("Check for typos in the property name. Verify the object has the expected shape. The API or data source may have changed.")),
    Rule(49, "shape_mismatch", "low",
         m(r"(?i)expected[^\r\n]*object|expected[^\r\n]*array|cannot[^\r\n]*iterate"),
         Text("Data shape mismatch: the code received a different data structure than expected. {m}"),
         Text("Verify the data shape matches what the consuming code expects. Add runtime validation or type guards at the boundary where data enters.")),
    Rule(50, "index_out_of_bounds", "medium",
         m(r"(?i)index[^\r\n]*out of[^\r\n]*(?:bound|range)"),
         Text("Index out of bounds: {m}. An array or string was accessed beyond its length."),
         Text("Add bounds checking before array access. Verify array length before indexing. Check for off-by-one errors.")),
    Rule(51, "undefined_or_null", "medium",
         m(r"(?i)is (?:undefined|null)\z", r"(?i)\bundefined\b[^\r\n]*\bnot\b[^\r\n]*\bobject\b"),
         Text("A value is unexpectedly null or undefined: {m}"),
         Text("Add a null/undefined check at {loc}. Trace the value back to its source to find where it should have been set."),
         "loc"),
]

# What a run gets when no rule matched any of its failures.
UNKNOWN = Rule(
    UNKNOWN_RANK, "unknown", "low", [],
    Text("Could not automatically categorize this error: {m}"),
    Text("Review the error message and stack trace manually. The error pattern was not recognized by the heuristic engine."),
)
