from .arrays import action_token, action_type_name, pad_array
from .casts import day_of_text, lenient_cast
from .draws import chance, draw, hash_key

__all__ = [
    "action_token",
    "action_type_name",
    "chance",
    "day_of_text",
    "draw",
    "hash_key",
    "lenient_cast",
    "pad_array",
]
