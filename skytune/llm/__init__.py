"""Operators for preparing large text corpora.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered queries, every other module one operator (or a helper shared by
several): ``quality``, ``suffix_dedup``, ``lm_score``, ``sp_lattice``,
``mixing``, ``lang_id``, ``line_dedup``, ``secret_scan``, ``embed_dedup`` and
``near_dedup``.
"""
