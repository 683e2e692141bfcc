"""Training-data operators: thirteen corpus jobs expressed as Spark DataFrame plans.

Nothing outside this subpackage imports it.  Each module holds one operator with
a general interface; ``queries.py`` derives the contract columns from them.
"""
