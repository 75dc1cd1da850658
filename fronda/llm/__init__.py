"""Training-data operators. Nothing outside this package imports it.

``registry`` lists one query per operator; see each module's docstring for the
operator's method, parameters and edge cases.
"""
