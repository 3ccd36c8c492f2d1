"""heliogrid.functions"""
