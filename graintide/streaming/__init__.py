"""graintide.streaming"""
