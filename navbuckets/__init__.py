"""navbuckets: classify how listing pages are paged, as Spark DataFrame operators.

Buckets: ``next``, ``pageselect``, ``loadmore``, ``scrolldown`` (plus the admission
labels ``invalid_url`` / ``duplicate_in_input`` and ``error: ...`` strings).
Every stage takes and returns a DataFrame; the main path uses built-in Spark SQL
functions only, so Catalyst plans it and whole-stage codegen runs it.
"""

__all__ = ["classify_pages", "page_evidence"]


def __getattr__(name):  # lazy, so submodules import without a session
    if name in __all__:
        from navbuckets.plans import classify

        return getattr(classify, name)
    raise AttributeError(name)
