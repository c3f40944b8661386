"""Operators for preparing large training corpora. Nothing outside this
subpackage imports it; its queries are registered by ``tessera.llm.queries``."""
