"""heliogrid.streaming"""
