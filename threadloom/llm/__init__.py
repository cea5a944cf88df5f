"""Operators that prepare message streams as training data.

All of them take ``messages``: ``msg_id`` (BIGINT, the order of messages), ``text`` and, where an
operator says so, ``dataset``, ``lang``, ``conv_id``, ``pos`` and ``author``.  Other columns pass
through; a column that has the name of a result column is replaced by it.
"""
