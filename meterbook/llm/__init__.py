"""Operators of a training-data pipeline over whole document tables.

One module per operator, ``queries`` registers them.  Nothing outside this
package (and ``corpus_pipeline.py``) imports it.
"""
