"""Training-data operators: quality, toxicity, deduplication, mixing, packing and their kin.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries`` binds the ten ``opN_<name>`` queries to it.
"""
