from .keys import entity_key, given, label_key, strict_key  # noqa: F401
