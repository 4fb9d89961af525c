"""Training-data operators: near-dedup, media, chat, token files, filters, mixing and scoring.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it is there.
"""
