"""Fixed reference values: rule bases, severity maps, weakness dimension.

Everything in this module is data, not logic.  Values that must equal the
reference for identical results are stated plainly, in their natural order,
under FIXED VALUES markers.  ``cwe_dim`` / ``cwe_categories`` turn them into
small DataFrames (tens of rows) that the operators broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ----------------------------------------------------------------------------
# FIXED VALUES — severity / confidence / tool level maps
# ----------------------------------------------------------------------------
SEVERITY_CONFIDENCE = {"CRITICAL": 0.95, "HIGH": 0.85, "MEDIUM": 0.70, "LOW": 0.50}
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
SEVERITY_ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]

XML_TOOL_SEVERITY = {"error": "HIGH", "warning": "MEDIUM"}  # anything else -> MEDIUM
XML_TOOL_SKIP_SEVERITIES = ["style", "performance", "portability", "information"]
XML_TOOL_SECURITY_OVERRIDES = [
    "nullPointer", "nullPointerRedundantCheck", "nullPointerArithmetic",
    "uninitvar", "uninitdata", "uninitMemberVar", "uninitStructMember",
    "memleak", "resourceLeak", "memleakOnRealloc",
    "doubleFree", "deallocuse", "deallocDealloc",
    "bufferAccessOutOfBounds", "arrayIndexOutOfBounds",
    "negativeIndex", "negativeArraySize",
    "danglingLifetime", "danglingReference", "danglingTempReference",
    "invalidFunctionArg", "invalidIterator1",
    "zerodiv", "zerodivcond",
]
XML_TOOL_SUPPRESS = [
    "missingIncludeSystem", "missingInclude", "unknownMacro",
    "preprocessorErrorDirective", "noValidConfiguration",
    "unmatchedSuppression", "checkersReport",
]
CSV_TOOL_LEVEL = {5: "CRITICAL", 4: "HIGH", 3: "MEDIUM", 2: "LOW", 1: "LOW", 0: "LOW"}
JSON_TOOL_SEVERITY = {"ERROR": "HIGH", "WARNING": "MEDIUM", "INFO": "LOW"}

# ----------------------------------------------------------------------------
# FIXED VALUES — rule base 1 (per-function regex scan; flags: ignore case + dotall)
# (cwe_id, name, severity, [(pattern, message)], [safe patterns])
# The first CWE-415 pattern uses a back-reference without a group; the
# reference's regex engine rejects it and skips it, so it is kept but not live.
# ----------------------------------------------------------------------------
C_RULES = [
    ("CWE-120", "Buffer Copy without Checking Size", "CRITICAL", [
        (r"\bstrcpy\s*\(", "strcpy — no bounds checking"),
        (r"\bstrcat\s*\(", "strcat — no bounds checking"),
        (r"\bgets\s*\(", "gets — always unsafe, banned function"),
        (r"\bsprintf\s*\(", "sprintf — no bounds checking"),
        (r"\bvsprintf\s*\(", "vsprintf — no bounds checking"),
    ], [r"\bstrncpy\b", r"\bstrncat\b", r"\bsnprintf\b", r"\bfgets\b"]),
    ("CWE-134", "Externally-Controlled Format String", "HIGH", [
        (r"\bprintf\s*\(\s*[a-zA-Z_]\w*\s*\)", "printf with variable format string"),
        (r"\bfprintf\s*\([^,]+,\s*[a-zA-Z_]\w*\s*\)", "fprintf with variable format string"),
    ], [r'printf\s*\(\s*"']),
    ("CWE-78", "OS Command Injection", "HIGH", [
        (r"\bsystem\s*\(", "system() — potential command injection"),
        (r"\bpopen\s*\(", "popen() — potential command injection"),
    ], []),
    ("CWE-190", "Integer Overflow or Wraparound", "MEDIUM", [
        (r"\bmalloc\s*\([^)]*\*[^)]*\)", "malloc with multiplication — potential integer overflow"),
    ], []),
    ("CWE-676", "Use of Potentially Dangerous Function", "MEDIUM", [
        (r"\batoi\s*\(", "atoi — no error handling, prefer strtol"),
        (r"\batof\s*\(", "atof — no error handling, prefer strtod"),
    ], [r"\bstrtol\b", r"\bstrtod\b"]),
    ("CWE-242", "Use of Inherently Dangerous Function", "CRITICAL", [
        (r"\bgets\s*\(", "gets() is always unsafe — use fgets()"),
    ], []),
    ("CWE-415", "Double Free", "HIGH", [
        (r"\bfree\s*\([^)]+\).*\bfree\s*\(\1\)", "Possible double free of the same pointer"),
        (r"\bfree\s*\(\s*(\w+)\s*\)(?:(?!\1\s*=).)*?\bfree\s*\(\s*\1\s*\)",
         "Potential double free — pointer freed twice without reassignment"),
    ], [r"=\s*NULL\s*;"]),
    ("CWE-416", "Use After Free", "CRITICAL", [
        (r"\bfree\s*\(\s*(\w+)\s*\)\s*;(?:(?!\1\s*=).)*?\b\1\s*[\[\.\->]",
         "Potential use-after-free — pointer used after free()"),
        (r"\bfree\s*\(\s*(\w+)\s*\)\s*;(?:(?!\1\s*=).)*?\*\s*\1\b",
         "Potential use-after-free — pointer dereferenced after free()"),
    ], [r"=\s*NULL\s*;"]),
    ("CWE-476", "NULL Pointer Dereference", "HIGH", [
        (r"(\w+)\s*=\s*\b(malloc|calloc|realloc)\s*\([^)]*\)\s*;(?:(?!if\s*\(\s*\1|if\s*\(\s*!\s*\1|if\s*\(\s*NULL\s*[!=]=\s*\1).){0,120}[\[\.\->]",
         "Heap allocation result used without NULL check"),
        (r"(\w+)\s*=\s*\bfopen\s*\([^)]*\)\s*;(?:(?!if\s*\(\s*\1|if\s*\(\s*!\s*\1).){0,80}\bfread\b",
         "fopen() result used without NULL check before I/O"),
    ], []),
    ("CWE-362", "Race Condition (TOCTOU)", "MEDIUM", [
        (r"\b(access|stat|lstat)\s*\([^)]*\).*\b(open|fopen|creat|unlink|remove|rename)\s*\(",
         "TOCTOU race — check-then-act on filesystem without atomic operation"),
    ], []),
    ("CWE-457", "Use of Uninitialized Variable", "MEDIUM", [
        (r"\b(int|char|float|double|long|short|unsigned|size_t)\s+(\w+)\s*;(?:(?!\2\s*=).){0,100}\b\2\s*[+\-\*/\|&<>!=\[]",
         "Variable declared without initialisation then used — potential undefined behaviour"),
    ], [r"=\s*0\s*;", r"memset"]),
    ("CWE-252", "Unchecked Return Value", "LOW", [
        (r"^\s*(read|write|recv|send|fread|fwrite)\s*\(",
         "Return value of I/O function not checked — data loss or partial read/write"),
    ], [r"if\s*\(", r"while\s*\(", r"(\w+)\s*="]),
    ("CWE-119", "Buffer Overflow (Improper Memory Operations)", "HIGH", [
        (r"\b(memcpy|memmove)\s*\([^,]+,[^,]+,\s*[a-zA-Z_]\w*\s*\)",
         "memcpy/memmove with variable size — ensure bounds are checked"),
        (r"\[\s*(argc|argv|optarg|getenv|fgets|scanf|gets)\b",
         "Array indexed by external input — potential out-of-bounds access"),
    ], [r"sizeof\s*\(", r"MIN\s*\(", r"min\s*\("]),
    ("CWE-401", "Memory Leak", "MEDIUM", [
        (r"\b(malloc|calloc|strdup)\s*\([^)]*\)",
         "Heap allocation — ensure corresponding free() exists on all paths"),
    ], [r"\bfree\s*\(", r"\breturn\s+\w+\s*;"]),
    ("CWE-22", "Path Traversal", "HIGH", [
        (r"\.\./|\.\.\\\\", "Path traversal sequence (../) detected in string"),
        (r"\b(fopen|open|creat)\s*\([^\"]*\b(argv|getenv|optarg|input|param|request)\b",
         "File operation with external input — potential path traversal"),
    ], [r"realpath", r"basename"]),
]

# ----------------------------------------------------------------------------
# FIXED VALUES — rule base 2 (per-text detection; flag: ignore case only;
# a safe match suppresses the CWE).  The CWE-22 list in the reference fuses two
# literals into one pattern, reproduced here as the fused pattern.
# (cwe_id, name, severity, [patterns], [safe patterns], mitigation, example_fix)
# ----------------------------------------------------------------------------
TEXT_RULES = [
    ("CWE-89", "SQL Injection", "High",
     "Improper neutralization of special elements in SQL commands",
     [r"SELECT.*\+.*", r"INSERT.*\+.*", r"UPDATE.*\+.*", r"DELETE.*\+.*",
      r"execute\s*\(\s*['\"].*\+", r"query\s*=\s*['\"].*\+"],
     [r"execute\s*\(.*,\s*\(", r"prepare\s*\(", r"\?"],
     "Use parameterized queries or prepared statements. Never concatenate user input into SQL queries.",
     'query = "SELECT * FROM users WHERE id=?"; cursor.execute(query, (user_id,))'),
    ("CWE-79", "Cross-Site Scripting (XSS)", "Medium",
     "Improper neutralization of input during web page generation",
     [r"innerHTML\s*=", r"document\.write\s*\(", r"eval\s*\(", r"<script>", r"\.html\s*\("],
     [r"textContent\s*=", r"\.escape\(", r"sanitize\("],
     "Sanitize and escape user input. Use textContent instead of innerHTML. Implement Content Security Policy.",
     "element.textContent = userInput; // Instead of innerHTML"),
    ("CWE-78", "OS Command Injection", "High",
     "Improper neutralization of special elements in OS commands",
     [r"os\.system\s*\(", r"subprocess\.call\s*\(", r"exec\s*\(", r"shell=True", r"popen\s*\("],
     [r"shell=False", r"shlex\.quote\("],
     "Avoid system calls with user input. Use safe APIs. Always validate and sanitize inputs.",
     'subprocess.run(["command", arg1, arg2], shell=False)'),
    ("CWE-22", "Path Traversal", "High",
     "Improper limitation of pathname to restricted directory",
     [r"\.\./", r"r\.\.\file://", r"open\s*\(.*\+"],
     [r"os\.path\.abspath\(", r"Path\(.+\)\.resolve\("],
     "Validate file paths against whitelist. Use os.path.abspath() and check path prefix.",
     "safe_path = os.path.abspath(user_path); if safe_path.startswith(base_dir): ..."),
    ("CWE-120", "Buffer Overflow", "Critical",
     "Buffer copy without checking size of input",
     [r"strcpy\s*\(", r"strcat\s*\(", r"gets\s*\(", r"sprintf\s*\("],
     [r"strncpy\s*\(", r"strncat\s*\(", r"snprintf\s*\(", r"fgets\s*\("],
     "Use safe string functions: strncpy, snprintf, strncat. Always check buffer sizes.",
     "strncpy(dest, src, sizeof(dest)-1); dest[sizeof(dest)-1] = 0;"),
    ("CWE-798", "Hard-coded Credentials", "High",
     "Software contains hard-coded credentials",
     [r"password\s*=\s*['\"][^'\"]+['\"]", r"pwd\s*=\s*['\"][^'\"]+['\"]", r"api_key\s*=\s*['\"][^'\"]+['\"]",
      r"secret\s*=\s*['\"][^'\"]+['\"]", r"token\s*=\s*['\"][^'\"]+['\"]"],
     [r"os\.environ\[", r"getenv\(", r"config\."],
     "Use environment variables or secure credential storage. Never commit credentials to code.",
     'password = os.environ.get("DB_PASSWORD")'),
    ("CWE-327", "Use of Broken Crypto", "High",
     "Use of broken or risky cryptographic algorithm",
     [r"MD5\s*\(", r"SHA1\s*\(", r"DES\s*\(", r"RC4\s*\("],
     [r"SHA256\s*\(", r"SHA512\s*\(", r"AES\s*\("],
     "Use modern cryptographic algorithms: SHA-256, SHA-512, AES. Avoid MD5, SHA1, DES.",
     "hashlib.sha256(data).hexdigest()  # Instead of md5"),
]

# ----------------------------------------------------------------------------
# FIXED VALUES — call rules (rule ids, severities, CWE, messages of the
# reference's local pattern-rule file).  The structural patterns are re-aimed
# as regexes (our own), see ``CALL_RULE_REGEX``.
# ----------------------------------------------------------------------------
CALL_RULES = [
    ("c-buffer-overflow-strcpy", "ERROR", "CWE-120", "Use of strcpy without bounds checking can lead to buffer overflow (CWE-120)"),
    ("c-buffer-overflow-strcat", "ERROR", "CWE-120", "Use of strcat without bounds checking can lead to buffer overflow (CWE-120)"),
    ("c-buffer-overflow-sprintf", "ERROR", "CWE-120", "Use of sprintf without bounds checking can lead to buffer overflow (CWE-120)"),
    ("c-buffer-overflow-gets", "ERROR", "CWE-120", "Use of gets() is inherently unsafe and banned (CWE-120, CWE-242)"),
    ("c-command-injection-system", "ERROR", "CWE-78", "Use of system() can lead to command injection (CWE-78)"),
    ("c-command-injection-popen", "WARNING", "CWE-78", "Use of popen() can lead to command injection (CWE-78)"),
    ("c-format-string", "ERROR", "CWE-134", "Potential format string vulnerability (CWE-134)"),
    ("c-dangerous-atoi", "WARNING", "CWE-676", "Use of atoi has no error handling - prefer strtol (CWE-676)"),
    ("c-integer-overflow-malloc", "WARNING", "CWE-190", "Potential integer overflow in malloc size calculation (CWE-190)"),
]
# Our regex rendering of the call patterns: name(...) calls; the format-string
# rule requires a bare identifier as the format argument (so a literal is
# excluded); the malloc rule keeps its regex.
CALL_RULE_REGEX = {
    "c-buffer-overflow-strcpy": r"\bstrcpy\s*\(",
    "c-buffer-overflow-strcat": r"\bstrcat\s*\(",
    "c-buffer-overflow-sprintf": r"\bsprintf\s*\(",
    "c-buffer-overflow-gets": r"\bgets\s*\(",
    "c-command-injection-system": r"\bsystem\s*\(",
    "c-command-injection-popen": r"\bpopen\s*\(",
    "c-format-string": r"\bf?printf\s*\(\s*(?:[A-Za-z_]\w*\s*,\s*)?[A-Za-z_]\w*\s*\)",
    "c-dangerous-atoi": r"\batoi\s*\(",
    "c-integer-overflow-malloc": r"malloc\s*\([^)]*\*[^)]*\)",
}

# ----------------------------------------------------------------------------
# FIXED VALUES — keyword detection (lower-cased substring tests)
# ----------------------------------------------------------------------------
KEYWORD_RULES = [
    ("CWE-120", "strcpy|strcat|gets|scanf", "Buffer Overflow"),
    ("CWE-416", "use.*after.*free|UAF", "Use-After-Free"),
    ("CWE-476", "NULL|nullptr|!ptr", "Null Pointer Dereference"),
    ("CWE-190", "overflow|INT_MAX|UINT_MAX", "Integer Overflow"),
    ("CWE-835", "while.*1|for.*ever|infinite", "Infinite Loop"),
]

# ----------------------------------------------------------------------------
# FIXED VALUES — weakness dimension (cwe_id, name, severity, cvss, mitigation,
# example_fix) and categories
# ----------------------------------------------------------------------------
CWE_DIM = [
    ("CWE-119", "Improper Restriction of Operations within the Bounds of a Memory Buffer", "CRITICAL", 9.8,
     "The software performs operations on a memory buffer without restricting the size of operations to the buffer boundaries.",
     "Use safe buffer-handling functions (snprintf, strncpy). Validate all indices and sizes before memory access.",
     "Replace: memcpy(dst, src, len)  →  if (len <= sizeof(dst)) memcpy(dst, src, len);"),
    ("CWE-120", "Buffer Copy without Checking Size of Input (Classic Buffer Overflow)", "CRITICAL", 9.8,
     "The program copies an input buffer to an output buffer without verifying that the size of the input buffer is less than the size of the output buffer.",
     "Replace unbounded copy functions: strcpy→strncpy, sprintf→snprintf, gets→fgets. Always check destination size.",
     "strncpy(dest, src, sizeof(dest)-1); dest[sizeof(dest)-1] = '\\0';"),
    ("CWE-121", "Stack-based Buffer Overflow", "CRITICAL", 9.8,
     "A stack-based buffer overflow condition is a condition where the buffer being overwritten is allocated on the stack.",
     "Use bounded string functions. Enable stack protectors (-fstack-protector). Use ASLR.",
     "char buf[256]; fgets(buf, sizeof(buf), stdin);"),
    ("CWE-122", "Heap-based Buffer Overflow", "CRITICAL", 9.8,
     "A heap-based buffer overflow is a condition where the buffer being overwritten is allocated in the heap portion of memory.",
     "Validate allocation sizes. Use calloc for zero-initialised memory. Check return values of realloc.",
     "char *buf = calloc(size + 1, 1); if (!buf) return -1;"),
    ("CWE-125", "Out-of-bounds Read", "HIGH", 7.5,
     "The software reads data past the end, or before the beginning, of the intended buffer.",
     "Always validate index values against buffer length before reading.",
     "if (index < array_len) value = array[index];"),
    ("CWE-787", "Out-of-bounds Write", "CRITICAL", 9.8,
     "The software writes data past the end, or before the beginning, of the intended buffer.",
     "Validate index and size parameters. Use bounded write functions.",
     "if (offset + len <= buf_size) memcpy(buf + offset, data, len);"),
    ("CWE-416", "Use After Free", "CRITICAL", 9.8,
     "Referencing memory after it has been freed can cause a program to crash or execute arbitrary code.",
     "Set pointers to NULL immediately after free. Use static analysis to detect dangling pointers.",
     "free(ptr); ptr = NULL;"),
    ("CWE-415", "Double Free", "CRITICAL", 9.8,
     "The product calls free() twice on the same memory address, potentially leading to corruption of the memory allocator.",
     "Set pointer to NULL after free to prevent double-free. Use ASAN during testing.",
     "free(ptr); ptr = NULL;  /* second free(ptr) is now a safe no-op */"),
    ("CWE-476", "NULL Pointer Dereference", "HIGH", 7.5,
     "A NULL pointer dereference occurs when the application dereferences a pointer that it expects to be valid, but is NULL.",
     "Always check pointer return values before dereferencing. Use assertions in debug builds.",
     "char *p = malloc(size); if (p == NULL) { handle_error(); return; }"),
    ("CWE-401", "Missing Release of Memory after Effective Lifetime (Memory Leak)", "MEDIUM", 5.3,
     "The software does not sufficiently track and release allocated memory after it has been used.",
     "Ensure every malloc/calloc/realloc has a corresponding free on all code paths, including error paths.",
     "Use goto-cleanup pattern: goto cleanup; ... cleanup: free(buf); return ret;"),
    ("CWE-190", "Integer Overflow or Wraparound", "HIGH", 8.1,
     "The software performs a calculation that can produce an integer overflow or wraparound.",
     "Use safe integer arithmetic. Check for overflow before operations. Use size_t for sizes.",
     "if (a > SIZE_MAX / b) { error(); } else { result = a * b; }"),
    ("CWE-191", "Integer Underflow", "HIGH", 8.1,
     "The product subtracts one value from another, such that the result is less than the minimum allowable integer value.",
     "Check that subtraction result will not underflow before performing the operation.",
     "if (a >= b) { result = a - b; } else { handle_underflow(); }"),
    ("CWE-189", "Numeric Errors", "MEDIUM", 5.3,
     "Weaknesses in this category are related to improper calculation or conversion of numbers.",
     "Validate numeric inputs. Use appropriate data types. Check for overflow/underflow.",
     "Prefer size_t for sizes; check casts between signed and unsigned."),
    ("CWE-20", "Improper Input Validation", "HIGH", 7.5,
     "The product does not validate or incorrectly validates input that can affect the control flow or data flow of a program.",
     "Validate all external inputs against expected type, length, range, and format.",
     "if (len < 0 || len > MAX_LEN) { return ERROR_INVALID; }"),
    ("CWE-134", "Use of Externally-Controlled Format String", "HIGH", 8.6,
     "The software uses a function that accepts a format string as an argument, but the format string originates from an external source.",
     "Never pass user-controlled strings as format arguments. Use constant format strings.",
     'printf("%s", user_input);  // NOT printf(user_input);'),
    ("CWE-78", "OS Command Injection", "CRITICAL", 9.8,
     "The software constructs all or part of an OS command using externally-influenced input.",
     "Avoid system()/popen(). Use exec-family with argument arrays. Validate and sanitise all inputs.",
     'execl("/bin/ls", "ls", "-l", dir_path, NULL);  // NOT system(cmd);'),
    ("CWE-22", "Path Traversal", "HIGH", 7.5,
     'The software uses external input to construct a pathname to access a restricted directory, but does not properly neutralize sequences such as "..".',
     "Canonicalise paths with realpath(). Check that resolved path starts with the expected base directory.",
     "char *resolved = realpath(user_path, NULL); if (strncmp(resolved, base, strlen(base)) != 0) abort();"),
    ("CWE-89", "SQL Injection", "CRITICAL", 9.8,
     "The software constructs SQL statements from user input without proper neutralisation.",
     "Use parameterised queries / prepared statements. Never concatenate user input into SQL.",
     'sqlite3_prepare_v2(db, "SELECT * FROM t WHERE id=?", -1, &stmt, 0); sqlite3_bind_int(stmt, 1, id);'),
    ("CWE-676", "Use of Potentially Dangerous Function", "MEDIUM", 5.3,
     "The program invokes a potentially dangerous function that could introduce a vulnerability.",
     "Replace dangerous functions with safer alternatives (atoi→strtol, gets→fgets).",
     "long val = strtol(str, &endptr, 10); if (*endptr != '\\0') handle_error();"),
    ("CWE-242", "Use of Inherently Dangerous Function", "CRITICAL", 9.8,
     "The program calls a function that can never be guaranteed to work safely (e.g. gets()).",
     "Remove all calls to gets(). Use fgets() with explicit buffer size.",
     "fgets(buf, sizeof(buf), stdin);"),
    ("CWE-362", "Race Condition (Concurrent Execution using Shared Resource)", "HIGH", 8.1,
     "The program contains a code sequence that can run concurrently with other code, and requires temporary exclusive access to a shared resource.",
     "Use mutexes / locks around shared resource access. Minimise the critical section.",
     "pthread_mutex_lock(&mtx); shared_counter++; pthread_mutex_unlock(&mtx);"),
    ("CWE-667", "Improper Locking", "HIGH", 7.5,
     "The software does not properly acquire or release a lock on a resource, leading to unexpected behaviour.",
     "Use RAII-style locking in C++ or goto-cleanup in C to guarantee lock release.",
     "std::lock_guard<std::mutex> guard(mtx);  // automatic unlock on scope exit"),
    ("CWE-327", "Use of Broken or Risky Cryptographic Algorithm", "HIGH", 7.5,
     "The use of a broken or risky cryptographic algorithm (MD5, SHA-1, DES, RC4).",
     "Use modern algorithms: SHA-256, SHA-512, AES-256-GCM. Avoid MD5, SHA-1, DES.",
     "Use EVP_sha256() instead of EVP_md5() in OpenSSL."),
    ("CWE-798", "Hard-coded Credentials", "HIGH", 7.5,
     "The software contains hard-coded credentials such as passwords or cryptographic keys.",
     "Store secrets in environment variables or a secure vault. Never commit credentials.",
     'const char *key = getenv("API_KEY"); if (!key) abort();'),
    ("CWE-399", "Resource Management Errors", "MEDIUM", 5.3,
     "The software does not properly manage a resource throughout its lifetime.",
     "Track every acquired resource and ensure release on all code paths.",
     "Use goto-cleanup pattern or RAII for automatic resource management."),
    ("CWE-772", "Missing Release of Resource after Effective Lifetime", "MEDIUM", 5.3,
     "The software does not release a resource after its effective lifetime has ended (file handles, sockets, etc.).",
     "Close all file descriptors and sockets. Use cleanup labels in C.",
     'FILE *f = fopen(path, "r"); if (!f) return -1; ... fclose(f);'),
    ("CWE-400", "Uncontrolled Resource Consumption", "MEDIUM", 5.3,
     "The software does not properly control the allocation and maintenance of a limited resource.",
     "Set upper limits on allocations. Use resource quotas and timeouts.",
     "if (requested_size > MAX_ALLOC) { return ERROR_TOO_LARGE; }"),
    ("CWE-200", "Exposure of Sensitive Information to an Unauthorized Actor", "MEDIUM", 5.3,
     "The software exposes sensitive information to an actor not explicitly authorised to have access.",
     "Zero-out sensitive buffers after use. Avoid logging secrets. Restrict error messages.",
     "memset(password_buf, 0, sizeof(password_buf));"),
    ("CWE-264", "Permissions, Privileges, and Access Controls", "HIGH", 7.5,
     "Weaknesses in this category are related to the management of permissions, privileges, and other security features.",
     "Apply principle of least privilege. Drop privileges after startup. Validate file permissions.",
     "setuid(unprivileged_uid); setgid(unprivileged_gid);"),
    ("CWE-79", "Cross-Site Scripting (XSS)", "MEDIUM", 6.1,
     "Improper neutralization of input during web page generation.",
     "Sanitise and escape user input. Use Content Security Policy headers.",
     "html_escape(user_input, escaped_buf, sizeof(escaped_buf));"),
]
UNKNOWN_CWE_MITIGATION = "Manual code review recommended — this finding was not mapped to a known CWE."
UNKNOWN_CWE_RECOMMENDATION = "Inspect the flagged code for potential security issues."

CWE_CATEGORIES = [
    ("memory", ["CWE-119", "CWE-120", "CWE-121", "CWE-122", "CWE-125", "CWE-787",
                "CWE-416", "CWE-415", "CWE-476", "CWE-401"]),
    ("integer", ["CWE-190", "CWE-191", "CWE-189"]),
    ("input_validation", ["CWE-20", "CWE-134", "CWE-78", "CWE-22", "CWE-89"]),
    ("dangerous_functions", ["CWE-676", "CWE-242"]),
    ("concurrency", ["CWE-362", "CWE-667"]),
    ("crypto", ["CWE-327", "CWE-798"]),
    ("resource", ["CWE-399", "CWE-772", "CWE-400"]),
    ("information", ["CWE-200", "CWE-264", "CWE-79"]),
]

# ----------------------------------------------------------------------------
# FIXED VALUES — extension -> language maps
# ----------------------------------------------------------------------------
INGEST_EXTENSIONS = {".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp",
                     ".cxx": "cpp", ".hh": "cpp", ".hxx": "cpp"}
PARSER_EXTENSIONS = {".py": "python", ".java": "java", ".c": "c", ".cpp": "cpp", ".cc": "cpp",
                     ".cxx": "cpp", ".h": "cpp", ".hpp": "cpp", ".php": "php", ".js": "javascript",
                     ".jsx": "javascript", ".ts": "javascript", ".tsx": "javascript", ".go": "go",
                     ".rs": "rust", ".rb": "ruby", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift"}
SKIP_DIRS = [".git", "__pycache__", "node_modules", "build", "bin", "obj", ".svn", ".hg", "CMakeFiles", ".vs"]
MAX_FILE_SIZE = 1024 * 1024

# ----------------------------------------------------------------------------
# Regex helpers over the tables
# ----------------------------------------------------------------------------
_NON_RE2 = ("(?!", "(?=", "(?<", "\\1", "\\2")


def cwe_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        CWE_DIM, "cwe_id string, cwe_name string, dim_severity string, cvss double, description string, mitigation string, example_fix string")


def cwe_categories(spark: SparkSession) -> DataFrame:
    """Category -> cwe_id, one row per member."""
    return spark.createDataFrame(CWE_CATEGORIES, "category string, cwe_ids array<string>").select(
        "category", F.explode("cwe_ids").alias("cwe_id")
    )


def sql_values(rows: list[tuple], cols: list[str]) -> str:
    """Render literal rows as a DuckDB ``(VALUES ...) t(cols)`` table expression."""

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int,)):
            return str(v)
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(lit(x) for x in v) + "]::VARCHAR[]" if v else "[]::VARCHAR[]"
        return "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"


# FIXED VALUES — category -> split lists of the labelled test suite
TRAIN_CATEGORIES = [
    "CWE78", "CWE119", "CWE121", "CWE122", "CWE124", "CWE127",
    "CWE134", "CWE176", "CWE242", "CWE252", "CWE253", "CWE259",
    "CWE338", "CWE390", "CWE391", "CWE404", "CWE457", "CWE460",
    "CWE467", "CWE468", "CWE469", "CWE478", "CWE483", "CWE484",
    "CWE526", "CWE534", "CWE535", "CWE562", "CWE563", "CWE570",
    "CWE571", "CWE606", "CWE685", "CWE688", "CWE689", "CWE690",
]
VAL_CATEGORIES = [
    "CWE23", "CWE36", "CWE191", "CWE193", "CWE195", "CWE197",
    "CWE197", "CWE321", "CWE325", "CWE327", "CWE328", "CWE329",
    "CWE369", "CWE401", "CWE415", "CWE416", "CWE426", "CWE427",
    "CWE464", "CWE475", "CWE476", "CWE480", "CWE481", "CWE482",
]
TEST_CATEGORIES = [
    "CWE126", "CWE190", "CWE194", "CWE196", "CWE244", "CWE256",
    "CWE257", "CWE258", "CWE319", "CWE364", "CWE366", "CWE367",
    "CWE377", "CWE396", "CWE397", "CWE398", "CWE399", "CWE400",
    "CWE459", "CWE462", "CWE463", "CWE479", "CWE497", "CWE605",
    "CWE680", "CWE681", "CWE690", "CWE758", "CWE761", "CWE762",
]
