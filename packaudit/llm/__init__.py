"""Operators that turn a corpus of package files into training data.

Records are the library's ``files``: ``path`` identifies a file in the corpus (put the
package in front of package-relative paths, or pass any other orderable key under that
name) and ``content`` is its text.  Operators read those two columns, whatever else the
table holds.
"""
