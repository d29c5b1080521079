"""Training-data pipeline operators (see README.md, section "Training-data operators").

Nothing outside this subpackage imports it; ``__spark_entry__.py`` registers its
queries only when it can be imported.
"""
