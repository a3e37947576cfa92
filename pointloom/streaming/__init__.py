"""Nothing lives here: the engine has no event streams.

Loads are finite and a refresh reloads its window. Predicates, row validation and
bin columns are stateless expressions, so they also apply to a streaming DataFrame
unchanged.
"""
