"""Training-data operators: tokens, text quality, duplicates, sharding.

Every operator takes a DataFrame and returns a lazy DataFrame.  Nothing outside this subpackage imports it.
"""
