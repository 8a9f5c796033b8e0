"""Training-data operators: ten corpus operations built for clusters that lose executors and data that is skewed.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries only when it is present.
"""
