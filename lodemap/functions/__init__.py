"""lodemap.functions"""
