"""heliogrid.sources"""
