"""lodemap.streaming"""
