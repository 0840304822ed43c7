"""Fixed values that the rules compare against.

Every list below must equal the language's own names or the published rule names
for results to be right; none of them is derived.
"""

from __future__ import annotations

# --- fixed values: synchronisation calls -----------------------------------
ATOMIC_CALLS = [
    "AddInt32", "AddInt64", "AddUint32", "AddUint64", "AddUintptr",
    "CompareAndSwapInt32", "CompareAndSwapInt64", "CompareAndSwapPointer",
    "CompareAndSwapUint32", "CompareAndSwapUint64",
    "LoadInt32", "LoadInt64", "LoadPointer", "LoadUint32", "LoadUint64",
    "StoreInt32", "StoreInt64", "StorePointer", "StoreUint32", "StoreUint64",
]
ACQUIRE_CALLS = ["Lock", "RLock"]
RELEASE_CALLS = ["Unlock", "RUnlock"]
MUTEX_CALLS = ["Lock", "Unlock", "RLock", "RUnlock", "Wait"]
HEAVY_CALLS = [
    "fmt.Println", "fmt.Printf", "fmt.Sprintf", "sort.Slice", "sort.SliceStable",
    "append", "copy",
]

# --- fixed values: node kinds ----------------------------------------------
FUNCTION_KINDS = ["function_declaration", "method_declaration", "function_literal"]
CLOSURE_KINDS = ["function_literal", "go_statement"]
REFERENCE_KINDS = [
    "slice_type", "map_type", "channel_type", "function_type", "interface_type",
]
POINTER_TYPES = ["pointer", "slice", "map", "chan", "func", "interface"]
HIDDEN_SYMBOL_KINDS = ["function", "type", "package", "builtin", "label"]
COPY_LIST_KINDS = ["argument_list", "expression_list"]
COPY_OWNER_KINDS = [
    "call_expression", "assignment_statement", "short_var_declaration", "return_statement",
]
SCOPE_KINDS = [
    *FUNCTION_KINDS, "block", "if_statement", "for_statement", "switch_statement",
    "type_switch_statement", "select_statement", "case_clause",
]
ADDRESS_STOP_KINDS = [
    "assignment_statement", "short_var_declaration", "return_statement",
    "call_expression", "function_declaration", "method_declaration",
]
PUNCTUATION_KINDS = [
    "{", "}", "(", ")", "[", "]", ",", ";", ":", ".", "=", "+", "-", "*", "/", "%",
    "<", ">", "!", "&", "|", "^", "~", "?", "comment", "\n", " ",
]

# --- fixed values: decorations, weakest last in the order of priority -------
# (priority, kind, colour key, default colour)
KINDS = [
    (1, "Race", "raceColor", "red"),
    (2, "RaceLow", "raceLowColor", "orange"),
    (3, "AliasReassigned", "aliasReassignedColor", "purple"),
    (4, "AliasCaptured", "aliasCapturedColor", "magenta"),
    (5, "Pointer", "pointerColor", "blue"),
    (6, "Use", "useColor", "yellow"),
    (7, "Declaration", "declarationColor", "green"),
]

# --- fixed values: findings in order of precedence --------------------------
# (precedence, rule, diagnostic severity, message with %s for the name)
RULES = [
    (1, "field-race-high", "Warning", "Potential data race on `%s` in goroutine (%s)"),
    (2, "field-mixed-atomic", "Warning",
     "Field `%s` is accessed both atomically and non-atomically"),
    (3, "field-lock-coverage", "Warning",
     "Field `%s` has mixed synchronized/unsynchronized access"),
    (4, "field-heavy-under-lock", "Information",
     "Heavy operation under lock for field `%s` may hurt throughput"),
    (5, "field-retention", "Information", "%s: `%s`"),
    (6, "field-write-only", "Information", "Field `%s` appears write-only"),
    (7, "field-read-before-write", "Warning",
     "Field `%s` is read before first write in this execution context"),
    (8, "struct-large-copy", "Information",
     "Potential large struct copy by value for `%s`"),
]
# (rank, diagnostic severity)
SEVERITIES = [(1, "Error"), (2, "Warning"), (3, "Information"), (4, "Hint")]
RETAIN_SLICE = "Retention risk: sub-slice/sub-string may keep large backing memory"
RETAIN_MAP = "Retention risk: map reference can keep large object graph alive"

# --- fixed values: texts of variables and uses -------------------------------
# (name, line, type, uses)
SUMMARY_TEXT = "**Variable**: `%s`\n\n**Declared at**: line %d\n**Type**: %s\n**Uses**: %d\n"
SUMMARY_RACE = "**Warning**: Potential data race detected!\n"
# (race severity, text with name and access)
RACE_TEXTS = [
    ("High", "Use of `%s` in goroutine - HIGH PRIORITY data race (%s)"),
    ("Medium", "Use of `%s` in goroutine - potential data race (%s)"),
    ("Low", "Use of `%s` in goroutine - LOW PRIORITY (sync detected, %s)"),
]
DECLARATION_TEXT = "Declaration of `%s`"
WRITE_TEXT = "Reassignment of `%s`"
CAPTURED_TEXT = "Captured `%s` in closure/goroutine"
USE_TEXT = "Use of `%s`"
MIXED_TEXT = "mixed atomic/non-atomic access detected for field `%s`"
COVERAGE_TEXT = "lock coverage violation for field `%s`"
HEAVY_TEXT = "heavy call under lock while touching `%s`"
UNLOCKED_TEXT = "captured field access in goroutine without active lock"
WRITE_ONLY_TEXT = "field appears write-only in current file scope"
EARLY_READ_TEXT = "read-before-write pattern detected in current file scope"
COPY_TEXT = "potential large struct copy by value"

# --- fixed values: class of a position, by kind or by (kind, parent, field) --
CLASS_BY_KIND = [
    ("field_identifier", "FieldAccess"),
    ("type_identifier", "TypeReference"),
    ("package_identifier", "PackageReference"),
    ("function_declaration", "FunctionDeclaration"),
    ("go_statement", "GoroutineStatement"),
    ("channel_type", "ChannelType"),
    ("interface_type", "InterfaceType"),
    ("struct_type", "StructType"),
    ("identifier", "VariableUse"),
]
CLASS_BY_PARENT = [
    ("identifier", "var_spec", None, "VariableDeclaration"),
    ("identifier", "short_var_declaration", None, "VariableDeclaration"),
    ("identifier", "parameter_declaration", None, "ParameterDeclaration"),
    ("identifier", "field_identifier", None, "StructField"),
    ("identifier", "function_declaration", None, "FunctionName"),
    ("identifier", "call_expression", None, "FunctionCall"),
    ("identifier", "selector_expression", "field", "FieldAccess"),
    ("identifier", "selector_expression", None, "ObjectAccess"),
    ("identifier", "go_statement", None, "GoroutineContext"),
    ("identifier", "assignment_statement", None, "Assignment"),
]
DECL_KINDS = ["short_var_declaration", "var_spec", "parameter_declaration", "range_clause"]
GRAPH_TYPES = ["Variable", "Function", "Channel", "Goroutine", "SyncBlock"]
EDGE_TYPES = ["Use", "Call", "Send", "Receive", "Spawn", "Sync"]

# --- fixed values: cache and timing defaults ---------------------------------
TTL_SECONDS = 300
MAX_DOCUMENTS = 50
DEBOUNCE_MS = 300
CLIP_CHARS = 20000
