"""Column functions: literals, text and predicates."""

from .literals import (char_hex, duration_to_nanos, memory_to_bytes, parse_bool_literal,
                       unescape_char, unicode_code)
from .predicates import predicate_text, predicate_tree
from .text import (dedent, join_path, json_or_text, mask_tokens, normalize_uri, render_template,
                   render_with, resolve_variables, row_to_map)

__all__ = [
    "char_hex", "duration_to_nanos", "memory_to_bytes", "parse_bool_literal", "unescape_char", "unicode_code",
    "predicate_text", "predicate_tree", "dedent", "join_path", "json_or_text", "mask_tokens", "normalize_uri",
    "render_template", "render_with", "resolve_variables", "row_to_map",
]
